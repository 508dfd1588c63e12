"""The index at rest, whole runs and the change stream."""

import pytest
from pyspark.sql import functions as F

from pathlight.operators import BatchEmbedder, TfIdfEmbedder, ann_search, batch_search, ignore_filter, snapshot_diff
from pathlight.operators.embed import fit_idf
from pathlight.plans import add_delete_index, full_changes, full_index, incremental_index, index_diff, refit_model, refresh_cells
from pathlight.plans.pipelines import fit_model, stored_embedder, texts_of
from pathlight.session import scratch_dir
from pathlight.sources import IndexStore, State
from pathlight.streaming import apply_batch, stream_changes

ROWS = "file_path string, code_text string, embedding array<float>"
FILES = "file_path string, content string"

V1 = {
    "main.py": "def hello():    print('Hello, World!')",
    "utils.py": "def add(a, b):    return a + b",
    "README.md": "# Test Project: This is a test project for integration testing.",
}
V2 = {
    "main.py": V1["main.py"] + "\n# New comment at the end\n",
    "new_module.py": "import os\n\ndef new_function():\n    return 'new'\n",
    "README.md": V1["README.md"],
}


@pytest.fixture
def store(spark):
    return IndexStore(spark, scratch_dir(spark), 4)


@pytest.fixture
def embedder(letters):
    return BatchEmbedder(letters, 4)


def corpus(spark, files):
    return spark.createDataFrame(list(files.items()), FILES)


def rows(spark, *values):
    return spark.createDataFrame([(path, text, [1.0, 2.0, 3.0, 4.0]) for path, text in values], ROWS)


def paths(spark, *values):
    return spark.createDataFrame([(path,) for path in values], "file_path string")


def contents(store, version=None):
    return {row["file_path"]: row["code_text"] for row in store.read(version).collect()}


def ids(store, version=None):
    found = [(row["file_path"], row["id"]) for row in store.read(version).collect()]
    assert len({number for _, number in found}) == len(found)
    return dict(found)


def test_new_store_is_empty(store):
    assert store.state() == State(0, 0, None, 0)
    assert store.read().count() == 0 and store.index_state().count() == 0 and store.rejected().count() == 0


def test_publish_and_versions(spark, store):
    store.publish_index(rows(spark, ("a", "1"), ("b", "1"), ("c", "1")), source_version="x")
    first = ids(store)
    state = store.publish_index(rows(spark, ("b", "2"), ("d", "2"), ("c", "2")), paths(spark, "a", "c", "zz"), "y")
    assert (state.version, state.base, state.source_version) == (2, 1, "y")
    assert contents(store) == {"b": "2", "c": "2", "d": "2"}
    assert contents(store, 1) == {"a": "1", "b": "1", "c": "1"}
    second = ids(store)
    assert second["b"] == first["b"]
    assert second["c"] > max(first.values()) and second["d"] > max(first.values())
    store.publish_index(rows(spark, ("a", "3")))
    store.publish_index(deletes=paths(spark, "d"))
    assert contents(store) == {"a": "3", "b": "2", "c": "2"}
    assert store.state().source_version == "y"
    before = ids(store)
    assert store.compact().base == 5
    assert contents(store) == {"a": "3", "b": "2", "c": "2"} and ids(store) == before
    counts = [(r["version"], r["full"], r["upserted"], r["deleted"]) for r in store.index_state().collect()]
    assert counts == [(1, True, 3, 0), (2, False, 3, 3), (3, False, 1, 0), (4, False, 0, 1), (5, True, 3, 0)]


def test_last_write_of_a_batch_wins(spark, store):
    writes = spark.createDataFrame(
        [("a", "2", None, 2), ("a", "3", None, 3), ("a", "1", None, 1)], f"{ROWS}, seq int"
    )
    store.publish_index(writes, order=["seq"])
    assert contents(store) == {"a": "3"}


def test_broken_rows_are_set_aside(spark, store):
    store.publish_index(rows(spark, ("keep", "old"), ("gone", "old")))
    bad = spark.createDataFrame(
        [("keep", "new", [1.0]), ("x" * 256, "t", None), (None, "t", None), ("gone", None, None), ("fine", "t", None)], ROWS
    )
    store.publish_index(bad, paths(spark, "gone"))
    assert contents(store) == {"keep": "old", "fine": "t"}
    broken = {row["file_path"]: row["broken"] for row in store.rejected().collect()}
    assert broken == {"keep": ["dimension"], "x" * 256: ["path_too_long"], None: ["path_missing"], "gone": ["text_missing"]}
    assert store.index_state().filter("version = 2").first()["rejected"] == 4


def test_uncommitted_version_is_not_seen(spark, store):
    store.publish_index(rows(spark, ("a", "1")))
    torn = rows(spark, ("a", "torn"), ("b", "torn")).withColumn("id", F.lit(9)).withColumn("deleted", F.lit(False))
    store._write_segment(torn.withColumn("broken", F.lit(None)), 2)
    assert contents(store) == {"a": "1"}
    store.publish_index(rows(spark, ("b", "2")))
    assert contents(store) == {"a": "1", "b": "2"}


def test_failed_publish_changes_nothing(spark, store):
    store.publish_index(rows(spark, ("a", "1")))

    def load():
        def encode(texts):
            raise RuntimeError("model is down")

        return encode

    with pytest.raises(Exception, match="model is down"):
        full_index(store, corpus(spark, V1), embedder=BatchEmbedder(load, 4), source_version="v1")
    assert contents(store) == {"a": "1"} and store.state().version == 1


def test_first_version_is_written_without_a_shuffle(spark, store, embedder):
    from pathlight.functions import LANGUAGES
    from pathlight.plans.pipelines import finisher

    seen = []
    store._write_segment = lambda frame, version: seen.append(frame)
    store._commit = lambda *args, **options: State(1, 1)
    store.publish_index(corpus(spark, V1), finish=finisher(embedder, LANGUAGES))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_first_run(spark, store, embedder):
    full_index(store, corpus(spark, V1), embedder=embedder, source_version="v1")
    assert set(contents(store)) == set(V1)
    assert store.state().source_version == "v1"


def test_first_run_with_rules(spark, store, embedder):
    rules = spark.createDataFrame([("*.py",)], "rule string")
    full_index(store, corpus(spark, V1), rules, embedder, "v1")
    assert set(contents(store)) == {"README.md"}
    assert {r["file_path"] for r in full_changes(corpus(spark, V1), rules).collect()} == {"README.md"}


def test_incremental_run(spark, store, embedder):
    full_index(store, corpus(spark, V1), embedder=embedder, source_version="v1")
    before = ids(store)
    incremental_index(store, corpus(spark, V2), previous=corpus(spark, V1), embedder=embedder, source_version="v2")
    assert set(contents(store)) == set(V2)
    assert contents(store)["new_module.py"] == "def new_function():\n    return 'new'"
    assert contents(store)["main.py"] == V2["main.py"].strip()
    assert ids(store)["main.py"] == before["main.py"]
    assert store.state().source_version == "v2"
    assert {r["upserted"] for r in store.index_state().filter("version = 2").collect()} == {2}


@pytest.mark.parametrize("source", ["previous", "index", "lines"])
def test_incremental_equals_full(spark, embedder, source):
    stores = [IndexStore(spark, scratch_dir(spark), 4) for _ in range(2)]
    v2 = {**V2, "renamed.md": "moved", "blank.py": "import a\n"}
    v1 = {**V1, "old.md": "moved", "blank.py": "x = 1", "skip.log": "s"}
    full_index(stores[0], corpus(spark, v1), ["*.log"], embedder, "v1")
    lines = [("A", "new_module.py"), ("M", "main.py"), ("D", "utils.py"), ("M", "blank.py"), ("D", "skip.log")]
    given = spark.createDataFrame([(*line, None) for line in lines] + [("R100", "old.md", "renamed.md")],
                                  "status string, file_path string, new_path string")
    options = {"previous": {"previous": corpus(spark, v1)}, "index": {}, "lines": {"changes": given}}[source]
    incremental_index(stores[0], corpus(spark, v2), rules=["*.log"], embedder=embedder, source_version="v2", **options)
    full_index(stores[1], corpus(spark, v2), ["*.log"], embedder, "v2")
    assert contents(stores[0]) == contents(stores[1])
    assert "blank.py" not in contents(stores[0])
    left, right = ({r["file_path"]: r["embedding"] for r in s.read().collect()} for s in stores)
    assert left == right
    assert index_diff(stores[0].digests(), ignore_filter(corpus(spark, v2), ["*.log"])).count() == 0


def test_same_version_changes_nothing(spark, store, embedder):
    full_index(store, corpus(spark, V1), embedder=embedder)
    incremental_index(store, corpus(spark, V1), embedder=embedder)
    incremental_index(store, corpus(spark, V1), previous=corpus(spark, V1), embedder=embedder)
    assert contents(store) == {path: text.strip() for path, text in V1.items()}
    assert [r["upserted"] for r in store.index_state().collect()] == [3, 0, 0]


def test_changes_detected(spark):
    found = {(r["change"], r["file_path"]) for r in snapshot_diff(corpus(spark, V1), corpus(spark, V2)).collect()}
    assert found == {("A", "new_module.py"), ("M", "main.py"), ("D", "utils.py")}


def test_default_model_is_fitted_once_and_stored(spark):
    store = IndexStore(spark, scratch_dir(spark), 32)
    full_index(store, corpus(spark, V1), source_version="v1")
    model = stored_embedder(store).idf
    incremental_index(store, corpus(spark, V2), previous=corpus(spark, V1), source_version="v2")
    assert stored_embedder(store).idf == model and len(model) == 32
    expected = TfIdfEmbedder(model)(texts_of(corpus(spark, V2)))
    assert {r["file_path"]: r["embedding"] for r in store.read().collect()} == {
        r["file_path"]: r["embedding"] for r in expected.collect()
    }


def test_incremental_run_needs_a_model(spark, store):
    with pytest.raises(ValueError, match="no embedding model"):
        incremental_index(store, corpus(spark, V1))
    _, number = fit_model(store, texts_of(corpus(spark, V1)))
    assert number == 1
    with pytest.raises(ValueError, match="no embedding model"):  # written, but not committed with a version
        stored_embedder(store)
    full_index(store, corpus(spark, V1))
    assert stored_embedder(store).dim == 4


def test_add_and_delete_lists(spark, store, embedder):
    full_index(store, corpus(spark, V1), ["*.md"], embedder, "v1")
    files = corpus(spark, {**V2, "my file.md": "spaces"})
    add_delete_index(store, files, "README.md ./new_module.py missing.py", "utils.py  unknown.py", embedder)
    assert set(contents(store)) == {"main.py", "README.md", "new_module.py"}
    add_delete_index(store, files, ["my file.md"], [], embedder)
    add_delete_index(store, files, delete=paths(spark, "main.py"), embedder=embedder)
    assert set(contents(store)) == {"README.md", "new_module.py", "my file.md"}
    assert store.state().source_version == "v1"
    with pytest.raises(ValueError, match="add or to delete"):
        add_delete_index(store, files)


def test_path_added_and_deleted_ends_up_present(spark, store, embedder):
    full_index(store, corpus(spark, V1), embedder=embedder)
    add_delete_index(store, corpus(spark, V2), "main.py", "main.py", embedder)
    assert contents(store)["main.py"] == V2["main.py"].strip()


def test_failed_vectors_and_unreadable_files_are_set_aside(spark, store):
    def load():
        return lambda texts: [[] if "bad" in text else [1.0] * 4 for text in texts]

    files = corpus(spark, {"a.md": "good", "b.md": "bad", "c.md": " \n", "d.md": None})
    full_index(store, files, embedder=BatchEmbedder(load, 4))
    assert contents(store) == {"a.md": "good"}
    assert {r["file_path"]: r["broken"] for r in store.rejected().collect()} == {
        "b.md": ["embedding_missing"],
        "d.md": ["text_missing"],
    }


CHANGES = "change string, file_path string, content string, seq int"


def test_batches(spark, store, embedder):
    first = [("A", "a", "1", 1), ("A", "b", "1", 2), ("M", "a", "2", 3), ("X", "x", "?", 4), ("A", "s.log", "1", 5)]
    assert apply_batch(store, spark.createDataFrame(first, CHANGES), ["seq"], ["*.log"], embedder, batch_id=0)
    assert contents(store) == {"a": "2", "b": "1"}
    second = spark.createDataFrame([("D", "a", None, 6), ("M", "b", "  ", 7), ("D", "c", None, 8), ("A", "c", "3", 9)], CHANGES)
    assert apply_batch(store, second, ["seq"], embedder=embedder, batch_id=1)
    assert contents(store) == {"c": "3"}
    assert not apply_batch(store, second, ["seq"], embedder=embedder, batch_id=1)
    assert not apply_batch(store, spark.createDataFrame(first, CHANGES), ["seq"], embedder=embedder, batch_id=0)
    assert contents(store) == {"c": "3"} and store.state().version == 2
    assert apply_batch(store, spark.createDataFrame(first, CHANGES), ["seq"], embedder=embedder, stream="other", batch_id=0)


def test_stream_resumes_from_its_checkpoint(spark, store, embedder, tmp_path):
    source, checkpoint = tmp_path / "source", str(tmp_path / "checkpoint")

    def feed(name, *changes):
        spark.createDataFrame(list(changes), CHANGES).coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        query = stream_changes(
            store, stream.parquet(str(source)), checkpoint, ["seq"], embedder=embedder, compact_every=2
        )
        query.awaitTermination()

    feed("one", ("A", "a", "1", 1), ("A", "b", "1", 2))
    run()
    assert contents(store) == {"a": "1", "b": "1"}
    feed("two", ("M", "a", "2", 3), ("D", "b", None, 4))
    feed("three", ("A", "c", "3", 5), ("M", "a", "3", 6))
    run()
    assert contents(store) == {"a": "3", "c": "3"}
    version = store.state().version
    run()
    assert store.state().version == version
    assert store.state().base > 1  # folded into a full version on the way


def test_a_second_full_run_replaces_the_index_and_its_model(spark):
    store = IndexStore(spark, scratch_dir(spark), 32)
    full_index(store, corpus(spark, V1), source_version="v1")
    first, model = ids(store), stored_embedder(store).idf
    full_index(store, corpus(spark, V2), source_version="v2")
    assert set(contents(store)) == set(V2) and set(contents(store, 1)) == set(V1)
    assert ids(store)["main.py"] == first["main.py"]
    assert stored_embedder(store).idf != model
    expected = {r["file_path"]: r["embedding"] for r in stored_embedder(store)(texts_of(corpus(spark, V2))).collect()}
    assert {r["file_path"]: r["embedding"] for r in store.read().collect()} == expected


def test_a_failed_full_run_leaves_the_model(spark):
    store = IndexStore(spark, scratch_dir(spark), 32)
    full_index(store, corpus(spark, V1), source_version="v1")
    model = stored_embedder(store).idf
    store._write_segment = lambda *args: (_ for _ in ()).throw(RuntimeError("disk full"))
    with pytest.raises(RuntimeError):
        full_index(store, corpus(spark, V2), source_version="v2")
    del store._write_segment
    assert stored_embedder(store).idf == model and store.state().version == 1


def test_added_files_never_get_a_model_of_their_own(spark, store, embedder):
    full_index(store, corpus(spark, V1), embedder=embedder)
    with pytest.raises(ValueError, match="no embedding model"):
        add_delete_index(store, corpus(spark, V2), "new_module.py")
    empty = IndexStore(spark, scratch_dir(spark), 8)
    add_delete_index(empty, corpus(spark, V2), "new_module.py")
    assert stored_embedder(empty).dim == 8


@pytest.mark.parametrize("way", ["previous", "index", "changes"])
def test_an_unreadable_file_keeps_its_old_row(spark, store, embedder, way):
    full_index(store, corpus(spark, V1), embedder=embedder)
    bad = corpus(spark, {**V1, "utils.py": None})
    changes = spark.createDataFrame([("M", "utils.py")], "change string, file_path string")
    options = {"previous": {"previous": corpus(spark, V1)}, "index": {}, "changes": {"changes": changes}}[way]
    incremental_index(store, bad, embedder=embedder, **options)
    assert contents(store)["utils.py"] == V1["utils.py"]
    assert [(r["file_path"], r["broken"]) for r in store.rejected().collect()] == [("utils.py", ["text_missing"])]


def test_versions_by_name(spark, store, embedder):
    full_index(store, corpus(spark, V1), embedder=embedder, source_version="v1")
    incremental_index(store, corpus(spark, V2), embedder=embedder, base="v1", source_version="v2")
    assert {r["file_path"] for r in store.read(source_version="v1").collect()} == set(V1)
    assert {r["file_path"] for r in store.read(source_version="v2").collect()} == set(V2)
    for call in (
        lambda: store.read(999),
        lambda: store.read(source_version="v3"),
        lambda: incremental_index(store, corpus(spark, V2), embedder=embedder, base="invalid"),
    ):
        with pytest.raises(ValueError, match="version"):
            call()


def test_the_diff_reads_no_stored_text(spark, store, embedder):
    full_index(store, corpus(spark, V1), embedder=embedder, source_version="v1")
    plan = index_diff(store.digests(), corpus(spark, V2))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("code_text" not in line and "embedding" not in line for line in scans)


def test_removals_are_counted_whether_requested_or_not(spark, store, embedder):
    full_index(store, corpus(spark, {f"f{n}.md": "text" for n in range(30)}), embedder=embedder)
    later = corpus(spark, {f"f{n}.md": "text" if n < 5 else " " for n in range(29)})
    incremental_index(store, later, previous=corpus(spark, {f"f{n}.md": "text" for n in range(30)}), embedder=embedder)
    row = store.index_state().filter("version = 2").first()
    assert (row["upserted"], row["deleted"], row["requests"]) == (0, 25, 1)
    assert row["indexed_at"] is not None
    assert "ResolvedHint" not in store.read()._jdf.queryExecution().analyzed().toString()
    assert len(contents(store)) == 5


def test_ids_stay_dense_after_the_first_version(spark, store):
    store.publish_index(rows(spark, ("a", "1")))
    for n in range(3):
        store.publish_index(rows(spark, (f"b{n}", "1"), (f"c{n}", "1")))
    first = ids(store)["a"]
    assert sorted(ids(store).values())[1:] == list(range(store.state().last_id - 5, store.state().last_id + 1))
    assert first < store.state().last_id - 5


def test_merge_and_vacuum(spark, store):
    store.publish_index(rows(spark, *[(f"p{n}", "1") for n in range(40)]), source_version="x")
    store.publish_index(rows(spark, ("p1", "2"), ("q", "2")), paths(spark, "p2"))
    store.publish_index(rows(spark, ("p2", "3")), paths(spark, "q", "p3"))
    before = contents(store)
    state = store.merge()
    assert (state.version, state.base, state.source_version) == (4, 1, "x")
    assert contents(store) == before and contents(store, 2)["q"] == "2"
    store.vacuum()
    assert contents(store) == before and ids(store)
    assert [r["version"] for r in store.index_state().collect()] == [1, 2, 3, 4]
    store.compact()
    store.publish_index(rows(spark, ("r", "6")))
    store.vacuum()
    assert contents(store) == {**before, "r": "6"}
    assert contents(store, 4) == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        contents(store, 3)


def test_late_writes_of_a_stream_are_dropped(spark, store, embedder):
    def batch(number, *changes):
        apply_batch(store, spark.createDataFrame(list(changes), CHANGES), ["seq"], embedder=embedder, batch_id=number)

    batch(0, ("A", "a", "5", 5), ("D", "b", None, 9), ("A", "c", "1", 1))
    batch(1, ("M", "a", "2", 2), ("A", "b", "8", 8), ("M", "c", "10", 10))
    assert contents(store) == {"a": "5", "c": "10"}
    store.compact()
    store.vacuum()
    batch(2, ("M", "a", "4", 4), ("A", "b", "7", 7), ("M", "c", " ", 11))
    assert contents(store) == {"a": "5"}
    batch(3, ("A", "c", "10", 10), ("A", "b", "12", 12))
    assert contents(store) == {"a": "5", "b": "12"}


def test_files_of_a_long_stream_stay_bounded(spark, store, embedder, tmp_path):
    import os

    full_index(store, corpus(spark, {f"p{n}": "text" for n in range(50)}), embedder=embedder)
    sizes = []
    for number in range(24):
        change = spark.createDataFrame([("M", f"p{number % 5}", f"text {number}", number)], CHANGES).coalesce(1)
        apply_batch(store, change, ["seq"], embedder=embedder, batch_id=number)
        store.tidy(4)
        if number % 8 == 7:
            sizes.append(sum(len(names) for _, _, names in os.walk(store.root)))
    # Folding happens every few versions, each of which has rows and keys.
    assert sizes[2] <= sizes[0] + 16
    assert len(store._committed()) <= 6
    assert contents(store)["p3"] == "text 23"


def test_order_keys_sort_as_their_columns(spark):
    from pathlight.sources.store import order_key

    frame = spark.sql(
        "SELECT timestamp_ntz'2020-01-01' AS t, 'b' AS s, -5 AS n UNION ALL SELECT timestamp_ntz'1960-01-01', 'a', 7 "
        "UNION ALL SELECT timestamp_ntz'2020-01-01', 'ab', 10 UNION ALL SELECT timestamp_ntz'2020-01-01', 'a', 9 UNION ALL SELECT NULL, NULL, NULL"
    )
    for order in (["t", "s", "n"], ["n"], ["s", "n"]):
        rows = frame.withColumn("key", order_key(frame, order)).orderBy(*order).collect()
        keys = [r["key"] for r in rows]
        assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_one_row_for_each_path(spark, store, embedder):
    """Of several rows for one path one is kept, the same in a rerun; the others are set aside and counted."""
    given = [("a", "1"), ("a", "2"), ("b", "1"), (None, "x"), (None, "y")] + [("hot", str(n % 7)) for n in range(300)]
    states = []
    for other in (store, IndexStore(spark, scratch_dir(spark), 4)):
        states.append(other.publish_index(rows(spark, *given).repartition(5), source_version="x"))
        assert other.index_state().first()["rejected"] == 1 + 299 + 2 and other.index_state().first()["upserted"] == 3
        broken = other.rejected().groupBy("file_path").count().collect()
        assert {r["file_path"]: r["count"] for r in broken} == {"a": 1, "hot": 299, None: 2}
    assert contents(store) == contents(other) and set(contents(store)) == {"a", "b", "hot"}
    before = ids(store)
    store.publish_index(rows(spark, *given, ("c", "1")), paths(spark, "b", "b"))
    assert set(ids(store)) == {"a", "b", "c", "hot"} and ids(store)["a"] == before["a"] and ids(store)["hot"] == before["hot"]
    assert store.index_state().collect()[-1]["upserted"] == 4
    store.compact()
    assert len(contents(store)) == 4 and store.state().base == store.state().version
    repeated = corpus(spark, V1).unionByName(corpus(spark, V1))
    full_index(store, repeated, embedder=embedder)
    assert store.read().count() == len(V1)
    incremental_index(store, corpus(spark, V2).unionByName(corpus(spark, V2)), embedder=embedder)
    assert contents(store) == {path: text.strip() if path.endswith("md") else contents(store)[path] for path, text in V2.items()}


def test_a_publish_reads_only_the_buckets_it_touches(spark, monkeypatch):
    store = IndexStore(spark, scratch_dir(spark), 4, bucket_paths=50)
    store.publish_index(rows(spark, *[(f"p{n}", "1") for n in range(1000)]))
    assert store.state().buckets == 20
    read = []
    real = IndexStore._keys
    monkeypatch.setattr(IndexStore, "_keys", lambda self, committed, buckets=None: read.append(real(self, committed, buckets)) or read[-1])
    before = ids(store)
    read.clear()
    store.publish_index(rows(spark, ("p7", "2"), ("new", "2")), paths(spark, "p8"))
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "embedding" not in plan and "segments" not in plan
    assert 0 < len(read[0].select("bucket").distinct().collect()) <= 2
    after = ids(store)
    assert after["p7"] == before["p7"] and "p8" not in after and len(after) == 1000 and after["new"] > max(before.values())
    for _ in range(3):
        store.publish_index(rows(spark, ("p9", "3")))
    assert store.merge().buckets == 20 and ids(store) == after
    store.compact()
    store.vacuum()
    assert ids(store) == after and {r["file_path"] for r in store.digests().collect()} == set(after)


def test_runs_with_nothing_to_index(spark):
    store = IndexStore(spark, scratch_dir(spark), 4)
    state = full_index(store, corpus(spark, V1), ["*"], source_version="none")
    assert store.read().count() == 0 and state.source_version == "none"
    incremental_index(store, corpus(spark, V2), source_version="some")
    assert set(contents(store)) == set(V2)
    assert store.read_model().first()["total"] == 3
    empty = IndexStore(spark, scratch_dir(spark), 4)
    full_index(empty, corpus(spark, {"a.py": "import os\n", "b.md": " \n"}))
    assert empty.read().count() == 0
    only = IndexStore(spark, scratch_dir(spark), 4)
    add_delete_index(only, corpus(spark, V1), delete="main.py unknown.py")
    assert only.read().count() == 0
    add_delete_index(only, corpus(spark, V1), add="main.py")
    assert set(contents(only)) == {"main.py"} and only.read_model().first()["total"] == 1


def test_every_publish_folds_a_long_history(spark, store, monkeypatch):
    from pathlight.sources import store as module

    monkeypatch.setattr(module, "FOLD_EVERY", 4)
    store.publish_index(rows(spark, *[(f"p{n}", "1") for n in range(100)]))
    for n in range(12):
        store.publish_index(rows(spark, (f"p{n}", "2")))
        assert len(store._committed()) <= 5
    assert contents(store, 3)["p1"] == "2" and contents(store, 3)["p2"] == "1"


def test_old_marks_go(spark, store, embedder, monkeypatch):
    from pathlight.sources import store as module

    apply_batch(store, spark.createDataFrame([("D", "a", None, 9), ("A", "b", "1", 1)], CHANGES), ["seq"], embedder=embedder, batch_id=0)
    store.compact()
    assert store.places(paths(spark, "a")).first()["stored_seq"]
    store.compact()
    assert store.places(paths(spark, "a")).count() == 1
    monkeypatch.setattr(module, "MARK_DAYS", 0)
    store.compact()
    assert store.places(paths(spark, "a")).count() == 0 and store.places(paths(spark, "b")).count() == 1


def test_cells_follow_the_index(spark, store, tmp_path):
    import random

    chosen, path = random.Random(4), str(tmp_path / "cells")

    def some(prefix, count):
        return spark.createDataFrame([(f"{prefix}{n}", "t", [chosen.gauss(0, 1) for _ in range(4)]) for n in range(count)], ROWS)

    def exact():
        asked = store.read().limit(20).select(F.col("file_path").alias("query_id"), "embedding")
        found = ann_search(asked, refresh_cells(store, path, 8), 5, recall=1.0)
        shown = lambda hits: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in hits.collect())
        return shown(found) == shown(batch_search(asked, store.read(), 5))

    store.publish_index(some("a", 300))
    assert exact()
    built = len(list((tmp_path / "cells" / "rows").rglob("*.parquet")))
    store.publish_index(some("b", 40).unionByName(some("a", 3)), paths(spark, "a5", "a6"))
    store.publish_index(deletes=paths(spark, "b1"))
    assert exact() and len(list((tmp_path / "cells" / "deltas").iterdir())) == 1
    assert len(list((tmp_path / "cells" / "rows").rglob("*.parquet"))) == built
    assert exact() and len(list((tmp_path / "cells" / "deltas").iterdir())) == 1
    store.publish_index(some("c", 1000))
    assert exact() and exact()
    store.compact()
    assert exact()


def test_the_state_of_a_stream_tells_late_writes(spark, store, embedder, tmp_path, monkeypatch):
    """Across restarts and without a look into the index; a new checkpoint learns the places from the index once."""
    source = tmp_path / "source"

    def feed(name, *changes):
        spark.createDataFrame(list(changes), CHANGES).coalesce(1).write.parquet(str(source / name))

    def run(checkpoint, folder=source):
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        stream_changes(
            store, stream.parquet(str(folder)), str(tmp_path / checkpoint), ["seq"], ["*.log"], embedder, stream=checkpoint
        ).awaitTermination()

    settings = {name: spark.conf.get(name) for name in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")}
    monkeypatch.setattr(IndexStore, "places", lambda self, paths: pytest.fail("looked into the index"))
    feed("one", ("A", "a", "5", 5), ("D", "b", None, 9), ("A", "c", "1", 1), ("A", "a", "4", 4), ("A", "x.log", "1", 1), ("?", "a", "6", 6))
    run("first")
    assert contents(store) == {"a": "5", "c": "1"}
    feed("two", ("M", "a", "2", 2), ("A", "b", "8", 8), ("M", "c", "10", 10))
    run("first")
    assert contents(store) == {"a": "5", "c": "10"}
    feed("three", ("A", "b", "12", 12), ("D", "c", None, 11))
    feed("four", ("A", "c", "10", 10), ("M", "b", "11", 11))
    run("first")
    assert contents(store) == {"a": "5", "b": "12"}
    late = tmp_path / "late"
    spark.createDataFrame([("M", "a", "late", 3), ("A", "d", "1", 1), ("M", "c", "late", 10)], CHANGES).coalesce(1).write.parquet(str(late))
    run("second", late)
    assert contents(store) == {"a": "5", "b": "12", "d": "1"}
    assert {name: spark.conf.get(name) for name in settings} == settings


def test_moved_files_keep_their_vectors(spark, store, embedder):
    from pathlight.operators import snapshot_moves

    before = {"a.md": "one", "b.md": "two", "c.md": "same", "d.md": "same", "e.md": "same", "f.md": "gone", "g.md": "kept", "h.py": "x = 1",
              "i.log": "logged", "k.md": "hidden", "n.md": "", "bad.md": None}
    after = {"z/a.md": "one", "b.md": "changed", "c2.md": "same", "d2.md": "same", "g.md": "kept", "g2.md": "kept", "h.txt": "x = 1",
             "i.md": "logged", "k.log": "hidden", "new.md": "new", "n2.md": "", "bad2.md": None}
    found = sorted(((r["change"], r["file_path"], r["new_path"]) for r in snapshot_moves(corpus(spark, before), corpus(spark, after)).collect()), key=repr)
    pairs = [(x, y) for c, x, y in found if c == "R" and before[x] == "same"]
    assert len(pairs) == 2 and {y for _, y in pairs} == {"c2.md", "d2.md"} and {x for x, _ in pairs} < {"c.md", "d.md", "e.md"}
    rest = {x for x in ("c.md", "d.md", "e.md")} - {x for x, _ in pairs}
    assert [f for f in found if f[0] == "D"] == sorted([("D", "bad.md", None), ("D", rest.pop(), None), ("D", "f.md", None)])
    assert [f for f in found if f[0] == "A"] == [("A", "bad2.md", None), ("A", "g2.md", None), ("A", "new.md", None)]
    assert [f for f in found if f[0] == "M"] == [("M", "b.md", None)]
    assert {(x, y) for c, x, y in found if c == "R"} - set(pairs) == {("a.md", "z/a.md"), ("h.py", "h.txt"), ("i.log", "i.md"), ("k.md", "k.log"), ("n.md", "n2.md")}

    full_index(store, corpus(spark, before), ["*.log"], embedder)
    embedded = spark.sparkContext.accumulator(0)

    def load():
        def counted(texts):
            embedded.add(len(texts))
            return [[float(len(text)), 1.0, 2.0, 3.0] for text in texts]

        return counted

    incremental_index(store, corpus(spark, after), previous=corpus(spark, before), rules=["*.log"], embedder=BatchEmbedder(load, 4), moves=True)
    assert contents(store) == {path: text for path, text in after.items() if text and not path.endswith(".log")}
    # New, changed and copied files, one of another language, and one that was ignored before; not the three that moved.
    assert embedded.value == 5
    vectors = {r["file_path"]: r["embedding"] for r in store.read().collect()}
    old = {r["file_path"]: r["embedding"] for r in store.read(1).collect()}
    assert vectors["z/a.md"] == old["a.md"] and vectors["c2.md"] == old["c.md"] and vectors["g.md"] == old["g.md"]
    ids(store)


def test_many_files_with_the_same_contents_move(spark):
    from pathlight.operators import snapshot_moves

    before = spark.createDataFrame([(f"old/{n}", "" if n % 3 else str(n)) for n in range(600)], FILES)
    after = spark.createDataFrame([(f"new/{n}", "" if n % 3 else str(n)) for n in range(700)], FILES)
    found = snapshot_moves(before, after).collect()
    assert len(found) == 700 and sum(r["change"] == "R" for r in found) == 600 and sum(r["change"] == "A" for r in found) == 100
    assert len({r["new_path"] for r in found if r["new_path"]}) == 600


def test_a_refit_is_what_a_fit_would_give(spark):
    """After rows were added, replaced and removed; without a look at the texts."""
    store = IndexStore(spark, scratch_dir(spark), 32)
    full_index(store, corpus(spark, V1 | {"empty.md": "--", "gone.md": "words that go"}), source_version="v1")
    incremental_index(store, corpus(spark, V2 | {"empty.md": "--"}), source_version="v2")
    before, texts = ids(store), contents(store)
    state = refit_model(store)
    assert state.base == state.version and ids(store) == before and contents(store) == texts and state.source_version == "v2"
    fitted = fit_idf(store.read(), 32).orderBy("bucket").collect()
    assert store.read_model().select(*fitted[0].__fields__).orderBy("bucket").collect() == fitted
    plain = {r["file_path"]: r["e"] for r in TfIdfEmbedder(store.read_model())(store.read().drop("embedding"), out="e").collect()}
    for row in store.read().collect():
        assert max(abs(a - b) for a, b in zip(row["embedding"], plain[row["file_path"]], strict=True)) < 1e-6
    with pytest.raises(ValueError, match="no embedding model"):
        refit_model(IndexStore(spark, scratch_dir(spark), 32))
