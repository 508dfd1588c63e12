"""What a task holds at once does not grow with the tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pathlight.operators import ann, batch_search, build_cells, search

INDEX = "file_path string, embedding array<float>"


def directions(count, dim=16, seed=5):
    return np.random.default_rng(seed).normal(size=(count, dim))


def test_queries_go_to_groups_of_cells_and_not_to_every_cell(spark, monkeypatch):
    """Vectors without clusters: nearly every cell is within reach of a query, which a task with a group of them finds out."""
    rows = [(f"r{n:04}", [float(x) for x in v]) for n, v in enumerate(directions(600))]
    index = spark.createDataFrame(rows, INDEX).coalesce(2)
    asked = index.limit(60).selectExpr("cast(substr(file_path, 2) AS int) AS query_id", "embedding")
    copies, real = [], ann.block_search
    monkeypatch.setattr(ann, "block_search", lambda left, *rest: copies.append(left.count()) or real(left, *rest))
    found = batch_search(asked, index, 10, max_broadcast_bytes=0, block_rows=20)
    columns = ["query_id", "rank", "file_path", F.round("distance", 9)]
    assert sorted(found.select(*columns).collect()) == sorted(batch_search(asked, index, 10).select(*columns).collect())
    assert sum(copies) <= 3 * 60


def test_angles_to_many_centres_are_taken_in_parts():
    units, _ = search.unit_rows(directions(5000))
    centres = units[:2000].copy()
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, units.size + 1, 16, dtype=np.int32)), pa.array(units.ravel()))
    cells = ann.CellIndex(None, centres, lowest=np.full(2000, 0.9), counts=np.ones(2000))
    for work in (
        lambda: ann._place(vectors, centres),
        lambda: cells.near(units, 3),
        lambda: cells.within(units, np.full(5000, 0.1), 1.0),
    ):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 5000 * 2000 * 8


def test_undefined_distances_are_kept_once_for_all_queries(monkeypatch):
    kept, real = [], search._Nearest._keep
    monkeypatch.setattr(search._Nearest, "_keep", lambda self, query, *rest: kept.append(len(query)) or real(self, query, *rest))
    units = np.vstack([np.zeros((50, 4)), np.eye(4)])
    block = search.QueryBlock(pa.array(range(54), pa.int32()), units)
    rows = pa.table({"key": range(900), "v": pa.array([[0.0] * 4 if n % 3 else None for n in range(900)], pa.list_(pa.float64()))})
    found = pa.Table.from_batches(search._scan_block(rows.to_batches(max_chunksize=30), block, 5)).to_pylist()
    assert sum(kept) == 54 * 5
    assert [hit["key"] for hit in found if hit["query_id"] in (0, 53)] == [1, 2, 4, 5, 7] * 2


def test_a_filter_by_cell_places_rows_once(spark, capsys):
    cells = build_cells(spark.createDataFrame([(str(n), [float(x) for x in v]) for n, v in enumerate(directions(60))], INDEX), cells=3)
    cells.rows.filter("cell = 1 OR cell = 2").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
