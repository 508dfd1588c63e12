import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlight.functions import cosine_distance, register_functions
from pathlight.operators import (
    DEFAULT_SQL,
    TfIdfEmbedder,
    ann_search,
    append_changes,
    batch_search,
    build_cells,
    drift,
    encode_query,
    ranked_hits,
    search_text,
    split_queries,
    sql_search,
    top_k_search,
)
from pathlight.operators.ann import CellIndex
from pathlight.operators.search import block_search, hit_schema

INDEX = "file_path string, embedding array<float>"


def brute_force(queries, rows, k):
    """The definition of the search, row by row: number distances, then NaN, then missing; ties by path."""
    out = {}
    for query_id, q in queries:
        hits = []
        for path, v in rows:
            if q is None or v is None:
                hits.append(((2, 0.0), path, None))
                continue
            a, b = np.array(q, np.float64), np.array(v, np.float64)
            norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            if norm == 0 or not np.isfinite(norm):
                hits.append(((1, 0.0), path, math.nan))
            else:
                d = min(max(1 - (a * b).sum() / norm, 0.0), 2.0)
                hits.append(((0, round(d, 9)), path, d))
        out[query_id] = [(path, d) for _, path, d in sorted(hits, key=lambda h: (h[0], h[1]))[:k]]
    return out


def same(left, right):
    if left is None or right is None:
        return left is right
    return (math.isnan(left) and math.isnan(right)) or abs(left - right) < 1e-9


def assert_hits(found, expected):
    got = {}
    for row in sorted(found.collect(), key=lambda r: (str(r["query_id"]), r["rank"])):
        got.setdefault(row["query_id"], []).append((row["file_path"], row["distance"], row["rank"]))
    assert set(got) == {query_id for query_id, hits in expected.items() if hits}
    for query_id, hits in got.items():
        assert [h[2] for h in hits] == list(range(1, len(hits) + 1))
        assert [h[0] for h in hits] == [e[0] for e in expected[query_id]], query_id
        assert all(same(h[1], e[1]) for h, e in zip(hits, expected[query_id], strict=True))


@pytest.fixture(scope="module")
def vectors():
    """Random vectors, a third of them copies of one, besides zero, missing and opposite ones."""
    rng = np.random.default_rng(3)
    rows = [(f"r{i:03}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(f"copy{i:03}", rows[5][1]) for i in range(150)]
    rows += [("zero1", [0.0] * 8), ("zero2", [0.0] * 8), ("none1", None), ("opposite", [-x for x in rows[5][1]])]
    rows += [("nan", [math.nan, *rows[5][1][1:]]), ("inf", [*rows[6][1][:7], -math.inf]), ("all nan", [math.nan] * 8)]
    return rows


@pytest.fixture(scope="module")
def index(spark, vectors):
    return spark.createDataFrame(vectors, INDEX).repartition(5).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return [(i, vectors[i][1]) for i in range(40)] + [(99, [0.0] * 8), (98, [math.nan, *[1.0] * 7])]


def query_frame(spark, queries):
    return spark.createDataFrame(queries, "query_id int, embedding array<float>")


def test_cosine_distance_edge_cases(spark):
    rows = [
        ([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]),
        (None, [1.0, 0.0]), ([1.0, 0.0], None), ([math.nan, 1.0], [1.0, 0.0]), ([1.0, 0.0], [math.inf, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "a array<double>, b array<double>").coalesce(1)
    register_functions(spark)
    for column in (cosine_distance("a", "b"), F.expr("cosine_distance(a, b)")):
        out = [row[0] for row in frame.select(column).collect()]
        assert out[0] == 1.0 and abs(out[1]) < 1e-12 and out[2] == 2.0 and math.isnan(out[3]) and out[4:6] == [None, None]
        assert math.isnan(out[6]) and math.isnan(out[7])
    wrong = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    for column in (cosine_distance("a", "b"), F.expr("cosine_distance(a, b)")):
        with pytest.raises(Exception, match="different vector dimensions 1 and 2"):
            wrong.select(column).collect()


def test_top_k_is_a_partial_sort(spark, index, vectors):
    hits = top_k_search(index, vectors[5][1], 12)
    assert "TakeOrderedAndProject" in hits._jdf.queryExecution().executedPlan().toString()
    expected = brute_force([(0, vectors[5][1])], vectors, 12)[0]
    got = [(row["file_path"], row["distance"]) for row in hits.collect()]
    assert [g[0] for g in got] == [e[0] for e in expected]
    everything = top_k_search(index, vectors[5][1], 10_000).collect()
    assert [r["file_path"] for r in everything] == [e[0] for e in brute_force([(0, vectors[5][1])], vectors, 10_000)[0]]


def test_ranked_hits_lines(spark):
    hits = spark.createDataFrame(
        [("src/config.py", 0.3456), ("src/cli.py", 0.12341), ("src/search.py", 0.2345)], "file_path string, distance double"
    )
    rows = ranked_hits(hits).orderBy("rank").collect()
    assert [row["line"] for row in rows] == [
        "1. src/cli.py (distance: 0.1234)",
        "2. src/search.py (distance: 0.2345)",
        "3. src/config.py (distance: 0.3456)",
    ]
    assert ranked_hits(hits.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_batch_search(spark, index, vectors, queries, k):
    assert_hits(batch_search(query_frame(spark, queries), index, k), brute_force(queries, vectors, k))


def test_batch_search_beyond_the_broadcast_limit(spark, index, vectors, queries):
    found = batch_search(query_frame(spark, queries), index, 10, max_broadcast_bytes=64)
    assert_hits(found, brute_force(queries, vectors, 10))


def test_blocks_are_bounded_in_a_hot_cell(spark, index, vectors, queries):
    asked = query_frame(spark, queries)
    left = asked.select("query_id", F.col("embedding").alias("vector"), F.lit(7).alias("cell"))
    right = index.select(F.col("file_path").alias("key"), F.col("embedding").alias("vector"), F.lit(7).alias("cell"))
    schema = hit_schema(asked, index, "query_id", "file_path")
    found = block_search(left, right, schema, 10, "file_path", index_block=20, query_block_rows=3)
    assert_hits(found, brute_force(queries, vectors, 10))


def test_small_pruning_steps_give_the_same_hits(monkeypatch, vectors, queries):
    import pyarrow as pa

    from pathlight.operators import search

    monkeypatch.setattr(search, "_MATRIX_ELEMENTS", 50)
    table = pa.table({"q": [q for q, _ in queries], "v": pa.array([v for _, v in queries], pa.list_(pa.float32()))})
    rows = pa.table({"k": [p for p, _ in vectors], "v": pa.array([v for _, v in vectors], pa.list_(pa.float32()))})
    found = {}
    for batch in search._scan_block(rows.to_batches(max_chunksize=17), search.query_block(table), 4):
        for row in batch.to_pylist():
            found.setdefault(row["query_id"], []).append(row["key"])
    expected = brute_force(queries, vectors, 4)
    assert found == {q: [path for path, _ in hits] for q, hits in expected.items()}


def test_batch_search_without_queries_or_rows(spark, index, queries):
    assert batch_search(query_frame(spark, queries).limit(0), index, 3).count() == 0
    assert batch_search(query_frame(spark, queries), index.limit(0), 3).count() == 0
    assert batch_search(query_frame(spark, [(1, None)]), index, 3).count() == 0


def test_wrong_query_length_is_an_error(spark, index):
    with pytest.raises(Exception, match="different vector dimensions"):
        batch_search(spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<float>"), index, 3).collect()
    with pytest.raises(Exception, match="different vector dimensions"):
        top_k_search(index, [1.0, 2.0], 3).collect()


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_every_way_gives_as_many_hits_as_there_are(spark, index, vectors, k):
    asked = query_frame(spark, [(1, vectors[5][1])])
    wanted = min(k, len(vectors))
    cells = build_cells(index, cells=4)
    assert top_k_search(index, vectors[5][1], k).count() == wanted
    assert batch_search(asked, index, k).count() == wanted
    assert batch_search(asked, index, k, max_broadcast_bytes=0).count() == wanted
    assert ann_search(asked, cells, k, probes=4).count() == wanted
    assert ann_search(asked, cells, k, probes=4, max_broadcast_bytes=0).count() == wanted


def test_a_row_without_a_number_takes_nothing_from_the_others(spark):
    rows = [(f"r{n:02}", [float(n), 1.0]) for n in range(18)] + [("x", [math.nan, 1.0]), ("y", [1.0, math.inf])]
    frame = spark.createDataFrame(rows, INDEX).coalesce(1)
    for k in (1, 2, 5, 19):
        assert [r["file_path"] for r in top_k_search(frame, [17.0, 1.0], k).collect()][:18] == [f"r{n:02}" for n in range(17, -1, -1)][:k]


def test_ann_with_all_cells_is_exact(spark, index, vectors, queries):
    cells = build_cells(index, cells=6)
    assert cells.rows.count() == len(vectors)
    for k in (10, len(vectors)):
        found = ann_search(query_frame(spark, queries), cells, k, probes=6)
        assert_hits(found, brute_force(queries, vectors, k))
    joined = ann_search(query_frame(spark, queries), cells, 10, probes=6, max_broadcast_bytes=64)
    assert_hits(joined, brute_force(queries, vectors, 10))


def test_centres_are_fitted_on_all_rows_unless_told_otherwise(spark, index, vectors, monkeypatch):
    from pathlight.operators import ann

    fitted = []
    real = ann.KMeans.fit
    monkeypatch.setattr(ann.KMeans, "fit", lambda self, rows: fitted.append(rows.count()) or real(self, rows))
    build_cells(index, cells=2)
    build_cells(index, cells=2, training_rows=100)
    assert fitted[0] == len(vectors) - 6 and fitted[1] < 200


def test_copies_of_one_vector_are_spread_over_files(spark, tmp_path):
    frame = spark.createDataFrame([(f"r{n}", [1.0, 2.0]) for n in range(400)], INDEX)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        build_cells(frame, cells=2).write(str(tmp_path / "cells"), rows_per_file=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = spark.read.parquet(str(tmp_path / "cells" / "rows")).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in sizes) == 400 and max(r["count"] for r in sizes) <= 50
    assert len({r[0].rpartition("/")[2].split("-")[1] for r in sizes}) > 1


def test_ann_with_few_cells(spark, index, vectors, queries, tmp_path):
    cells = build_cells(index, cells=8)
    asked = query_frame(spark, queries)
    exact = {(q, path) for q, hits in brute_force(queries[:40], vectors, 5).items() for path, _ in hits}
    found = {(r["query_id"], r["file_path"]) for r in ann_search(asked, cells, 5, probes=4).collect()}
    assert len(exact & found) / len(exact) > 0.6
    by_join = ann_search(asked, cells, 5, probes=4, max_broadcast_bytes=64)
    assert {(r["query_id"], r["file_path"]) for r in by_join.collect()} == found
    cells.write(str(tmp_path / "cells"), rows_per_file=40)
    again = ann_search(asked, CellIndex.read(spark, str(tmp_path / "cells")), 5, probes=4)
    assert {(r["query_id"], r["file_path"]) for r in again.collect()} == found
    one = ann_search(asked.filter("query_id = 3"), CellIndex.read(spark, str(tmp_path / "cells")), 5, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and one.count() == 5


def test_split_queries(spark):
    queries = spark.createDataFrame([("a",), ("",), (" \n",), (None,)], "text string")
    asked, rejected = split_queries(queries)
    assert [r["text"] for r in asked.collect()] == ["a"]
    assert rejected.count() == 3


CORPUS = [
    ("src/auth.py", "def login(user, password): check the password of the user"),
    ("src/math.py", "def add(a, b): return the sum of two numbers"),
    ("README.md", "a project about nothing at all"),
]


@pytest.fixture(scope="module")
def text_index(spark):
    rows = spark.createDataFrame(CORPUS, "file_path string, code_text string")
    embedder = TfIdfEmbedder.fit(rows, 256)
    return embedder(rows).cache(), embedder


def test_search_text(text_index):
    index, embedder = text_index
    hits = search_text(index, "where is the user password checked", embedder, 2).orderBy("rank").collect()
    assert [hit["file_path"] for hit in hits][0] == "src/auth.py" and len(hits) == 2
    with pytest.raises(ValueError, match="query text is required"):
        search_text(index, "", embedder)


def test_sql_search(spark, text_index):
    index, embedder = text_index
    rows = sql_search(index, DEFAULT_SQL, query_text="sum of numbers", embedder=embedder).collect()
    assert rows[0]["file_path"] == "src/math.py" and len(rows) == 3
    assert rows[0]["distance"] < rows[1]["distance"]
    only = "SELECT file_path, cosine_distance(embedding, :embedding) AS d FROM code_chunks WHERE file_path LIKE '%.md' ORDER BY d"
    vector = encode_query(spark, "project", embedder)
    assert [r["file_path"] for r in sql_search(index, only, vector).collect()] == ["README.md"]
    assert sql_search(index, "SELECT count(*) AS n FROM code_chunks").first()["n"] == 3
    with pytest.raises(ValueError, match="query text must be provided"):
        sql_search(index, DEFAULT_SQL, embedder=embedder)
    with pytest.raises(Exception, match="no_such_table"):
        sql_search(index, "SELECT * FROM no_such_table").collect()


def clustered(spark, count=1200, groups=12, dim=6, seed=3):
    """Vectors that lie close around a few directions."""
    chosen = np.random.default_rng(seed)
    centres = chosen.normal(size=(groups, dim))
    rows = [(f"r{n:05}", (centres[n % groups] + 0.05 * chosen.normal(size=dim)).astype(np.float32).tolist()) for n in range(count)]
    return spark.createDataFrame(rows, INDEX), rows


def test_bounds_leave_out_cells_and_lose_nothing(spark):
    index, rows = clustered(spark)
    cells = build_cells(index, cells=30)
    asked = [(n, rows[n * 50][1]) for n in range(20)]
    hits = ann_search(query_frame(spark, asked), cells, 10, recall=1.0, report=True).cache()
    assert_hits(hits.drop("probed"), brute_force(asked, rows, 10))
    probed = {r["query_id"]: r["probed"] for r in hits.select("query_id", "probed").distinct().collect()}
    assert len(probed) == 20 and max(probed.values()) < 20
    joined = ann_search(query_frame(spark, asked), cells, 10, recall=1.0, report=True, max_broadcast_bytes=64)
    assert_hits(joined.drop("probed"), brute_force(asked, rows, 10))
    assert {r["query_id"]: r["probed"] for r in joined.select("query_id", "probed").distinct().collect()} == probed


def test_recall_at_the_defaults_and_fewer_probes_for_less(spark):
    chosen = np.random.default_rng(8)
    rows = [(f"r{n:05}", [float(x) for x in chosen.normal(size=16)]) for n in range(3000)]
    index = spark.createDataFrame(rows, INDEX).repartition(4).cache()
    asked = query_frame(spark, [(n, rows[n * 50][1]) for n in range(60)])
    exact = batch_search(asked, index, 10).cache()
    cells, probed = build_cells(index, cells=64), {}
    for recall, least in ((0.6, 0.5), (0.95, 0.9), (1.0, 1.0)):
        hits = ann_search(asked, cells, 10, recall=recall, report=True).cache()
        assert hits.join(exact, ["query_id", "file_path"], "left_semi").count() >= least * 600
        probed[recall] = hits.agg(F.avg("probed")).first()[0]
    assert probed[0.6] < probed[0.95] < probed[1.0]
    hits = ann_search(asked, build_cells(index), 10)
    assert hits.join(exact, ["query_id", "file_path"], "left_semi").count() >= 540


def test_ann_search_query_asks_for_every_row(spark, tmp_path):
    """Rows of any id are queries, those without a direction among them; only missing vectors are not."""
    from pathlight.plans.catalog import QUERIES

    chosen = np.random.default_rng(9)
    rows = [(n, n % 7, [float(x) for x in chosen.normal(size=8)]) for n in range(1, 300)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["ann_search"](spark, str(tmp_path)).collect()
    assert sorted(row["query_id"] for row in found) == [n for n, label, _ in rows if label != 4]
    assert {tuple(row)[1:] for row in found} == {(10, 10, True, True, True)}


def test_cells_follow_changes(spark, index, vectors, queries, tmp_path):
    path, rows = str(tmp_path / "cells"), dict(vectors)
    build_cells(index, cells=5).write(path)
    changes = [
        ({p: [-x for x in v] if v else v for p, v in vectors[:30]} | {"new/a": [1.0] * len(vectors[40][1])}, [p for p, _ in vectors[20:60]]),
        ({"new/b": None, "new/a": [0.0] * len(vectors[40][1])}, [vectors[100][0], "unknown"]),
        ({vectors[100][0]: vectors[101][1]}, []),
    ]
    for written, gone in changes:
        for path_gone in gone:
            rows.pop(path_gone, None)
        rows |= written
        upserts = spark.createDataFrame([(p, None if v is None else [float(x) for x in v]) for p, v in written.items()], INDEX)
        deletes = spark.createDataFrame([(p,) for p in gone], "file_path string") if gone else None
        append_changes(CellIndex.read(spark, path), path, upserts, deletes)
    followed = CellIndex.read(spark, path)
    assert followed.rows.count() == len(rows)
    assert_hits(ann_search(query_frame(spark, queries), followed, 10, recall=1.0), brute_force(queries, list(rows.items()), 10))
    assert_hits(ann_search(query_frame(spark, queries), followed, 10, probes=5), brute_force(queries, list(rows.items()), 10))
    one = ann_search(query_frame(spark, queries[:1]), followed, 5, probes=1)
    assert one._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [cell") >= 2
    known = drift(spark, path)
    assert 0 < known["later_share"] < 0.5 and known["angle_ratio"] > 0


def test_drift_asks_for_a_refit(spark, tmp_path):
    index, rows = clustered(spark, 200)
    path = str(tmp_path / "cells")
    build_cells(index, cells=12).write(path)
    assert drift(spark, path) == {"later_share": 0.0, "angle_ratio": 1.0, "refit": False}
    strange = spark.createDataFrame([(f"s{n}", [-x + n % 3 for x in v]) for n, (_, v) in enumerate(rows[:20])], INDEX)
    append_changes(CellIndex.read(spark, path), path, strange)
    assert drift(spark, path)["refit"] and drift(spark, path)["angle_ratio"] > 1.2


def test_an_index_without_a_direction_has_no_cells(spark, tmp_path):
    for rows in ([], [("a", None), ("b", [0.0, 0.0])]):
        frame = spark.createDataFrame(rows, INDEX)
        build_cells(frame).write(str(tmp_path / f"cells{len(rows)}"))
        cells = CellIndex.read(spark, str(tmp_path / f"cells{len(rows)}"))
        asked = query_frame(spark, [(1, [1.0, 2.0])])
        assert ann_search(asked, cells, 3).count() == len(rows)
        append_changes(cells, str(tmp_path / f"cells{len(rows)}"), spark.createDataFrame([("c", [1.0, 1.0])], INDEX))
        again = CellIndex.read(spark, str(tmp_path / f"cells{len(rows)}"))
        assert ann_search(asked, again, 3).count() == len(rows) + 1
    few = spark.createDataFrame([], "query_id int, embedding array<float>")
    index, _ = clustered(spark, 50)
    assert ann_search(few, build_cells(index, cells=4), 3).count() == 0


def test_blocks_that_cannot_hold_a_hit_are_left_out(spark, index, vectors, queries, monkeypatch):
    """Exact for odd vectors, and over clustered ones most pairs of a query and a block are never formed."""
    from pathlight.operators import ann

    for block in (20, 70):
        found = batch_search(query_frame(spark, queries), index, 10, max_broadcast_bytes=0, block_rows=block)
        assert_hits(found, brute_force(queries, vectors, 10))
    close, rows = clustered(spark)
    asked = [(n, rows[n * 10][1]) for n in range(120)]
    pairs = []
    real = ann.block_search
    monkeypatch.setattr(ann, "block_search", lambda left, *rest: pairs.append(left.count()) or real(left, *rest))
    found = batch_search(query_frame(spark, asked), close, 10, max_broadcast_bytes=0, block_rows=40)
    assert_hits(found, brute_force(asked, rows, 10))
    assert sum(pairs) < 120 * 30 / 3


def test_distance_in_sql(spark):
    register_functions(spark)
    pairs = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), (None, [1.0]), ([1.0], None), ([0.0], [1.0]), ([math.nan], [1.0]),
             ([math.inf, 1.0], [1.0, 1.0]), ([1.0, 2.0, 3.0], [-1.0, -2.0, -3.0]), ([], [])]
    frame = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "n int, a array<float>, b array<double>")
    frame.createOrReplaceTempView("pairs_of_vectors")
    plain = frame.select("n", cosine_distance("a", "b").alias("d")).orderBy("n").collect()
    told = spark.sql("SELECT n, cosine_distance(a, b) AS d FROM pairs_of_vectors ORDER BY n").collect()
    assert len(told) == 9 and all(same(x["d"], y["d"]) for x, y in zip(plain, told, strict=True))
    first = spark.sql("SELECT n FROM pairs_of_vectors WHERE size(a) = 2 ORDER BY cosine_distance(a, b), n")
    assert [r["n"] for r in first.collect()] == [1, 0, 6]
    assert "aggregate(" not in first._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="different vector dimensions"):
        spark.sql("SELECT cosine_distance(array(1.0D), array(1.0D, 2.0D)) AS d").collect()
    assert spark.sql("SELECT cosine_distance(a, b) AS d FROM pairs_of_vectors WHERE n > 100").collect() == []
