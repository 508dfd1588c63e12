import pytest

from pathlight.operators import (
    apply_changes,
    apply_summary,
    assign_ids,
    blank_filter,
    change_summary,
    dedupe_last_wins,
    delete_by_key,
    exists_filter,
    header_summary,
    quarantine,
    snapshot_diff,
    union_changes,
    upsert,
    validate_index,
)

INDEX = "id bigint, file_path string, code_text string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def test_blank_and_exists(spark):
    files = frame(spark, [("a", "x"), ("b", "　\n"), ("c", "")], "file_path string, code_text string")
    assert [r["file_path"] for r in blank_filter(files).collect()] == ["a"]
    paths = frame(spark, [("a",), ("z",)], "file_path string")
    assert rows_of(exists_filter(paths, files)) == [("a",)]


def test_header_summary(spark):
    files = frame(spark, [("a.py", "# c\nx"), ("b.py", "yy"), ("c.md", "# t")], "file_path string, content string")
    assert rows_of(header_summary(files)) == rows_of(
        frame(spark, [("python", 2, 7, 4), (None, 1, 3, 0)], "l string, f bigint, c bigint, s bigint")
    )


def test_validate_and_quarantine(spark):
    rows = [
        ("a", "t", [1.0, 2.0]),
        ("a", "t", [1.0, 2.0]),
        ("b" * 256, "t", [1.0, 2.0]),
        ("c", None, None),
        ("d", "t", [1.0]),
        ("e", "t", [1.0, None]),
        (None, "t", [1.0, 2.0]),
        ("f", "t", None),
        ("ü" * 255, "t", None),
    ]
    index = frame(spark, rows, "file_path string, code_text string, embedding array<float>")
    assert rows_of(validate_index(index, 2)) == sorted(
        [
            ("path_not_unique", "a", 2),
            ("path_too_long", "b" * 256, 1),
            ("text_missing", "c", 1),
            ("dimension", "d", 1),
            ("dimension", "e", 1),
            ("path_missing", None, 1),
        ],
        key=repr,
    )
    good, bad = quarantine(index, 2)
    assert sorted(r["file_path"] for r in good.collect()) == ["a", "a", "f", "ü" * 255]
    assert bad.count() == 5


FILES = "file_path string, content string"


def test_snapshot_diff_and_summary(spark):
    old = frame(spark, [("same", "1"), ("edit", "1"), ("gone", "1"), ("bad", None), ("worse", None)], FILES)
    new = frame(spark, [("same", "1"), ("edit", "2"), ("new", "1"), ("bad", None)], FILES)
    changes = snapshot_diff(old, new)
    assert rows_of(changes) == [("A", "new"), ("D", "gone"), ("D", "worse"), ("M", "edit")]
    assert rows_of(change_summary(changes)) == [("A", 1), ("D", 2), ("M", 1)]
    assert rows_of(snapshot_diff(new, new)) == []
    both = union_changes(changes.filter("change = 'A'"), changes.filter("change = 'M'"))
    assert rows_of(both) == [("A", "new"), ("M", "edit")]


def test_dedupe_last_wins_with_a_hot_key(spark):
    rows = [("hot", i) for i in range(5000)] + [(f"k{i}", i) for i in range(100)]
    latest = dedupe_last_wins(frame(spark, rows, "file_path string, seq int").repartition(8), ["seq"])
    assert latest.count() == 101
    assert latest.filter("file_path = 'hot'").first()["seq"] == 4999
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle


def test_delete_by_key_ignores_unknown(spark):
    index = frame(spark, [(1, "a", "x"), (2, "b", "y")], INDEX)
    assert rows_of(delete_by_key(index, frame(spark, [("b",), ("zz",)], "file_path string"))) == [(1, "a", "x")]


def test_assign_ids_depend_on_keys_only(spark):
    paths = frame(spark, [(f"dir/{i}",) for i in range(1000)], "file_path string")
    one = {r["file_path"]: r["id"] for r in assign_ids(paths.coalesce(1), 50).collect()}
    many = {r["file_path"]: r["id"] for r in assign_ids(paths.repartition(7), 50).collect()}
    assert one == many
    assert sorted(one.values()) == list(range(51, 1051))


def test_assign_ids_keeps_existing(spark):
    rows = frame(spark, [("a", 7), ("b", None), ("c", None)], "file_path string, id bigint")
    out = {r["file_path"]: r["id"] for r in assign_ids(rows, 10).collect()}
    assert out["a"] == 7 and sorted((out["b"], out["c"])) == [11, 12]


def test_upsert_keeps_ids(spark):
    index = frame(spark, [(1, "a", "x"), (2, "b", "y")], INDEX)
    new = frame(spark, [("b", "Y"), ("c", "z")], "file_path string, code_text string")
    assert rows_of(upsert(index, new)) == [(1, "a", "x"), (2, "b", "Y"), (3, "c", "z")]


def test_apply_changes(spark):
    index = frame(spark, [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], INDEX)
    writes = [("b", "1", 1), ("b", "3", 3), ("b", "2", 2), ("c", "new", 1), ("d", "d", 1)]
    upserts = frame(spark, writes, "file_path string, code_text string, seq int")
    deletes = frame(spark, [("a",), ("c",), ("unknown",)], "file_path string")
    out = {r["file_path"]: (r["id"], r["code_text"]) for r in apply_changes(index, upserts, deletes, ["seq"]).collect()}
    assert set(out) == {"b", "c", "d"}
    assert out["b"] == (2, "3")
    assert out["c"][1] == "new" and out["c"][0] > 3  # deleted, then inserted: a new row
    again = apply_changes(apply_changes(index, upserts, deletes, ["seq"]), upserts, deletes, ["seq"])
    assert {(r["file_path"], r["code_text"]) for r in again.collect()} == {(p, t) for p, (_, t) in out.items()}


def test_applying_a_diff_gives_the_later_state(spark):
    old = frame(spark, [(i, f"f{i}", f"t{i}") for i in range(50)], INDEX)
    new = [(f"f{i}", f"t{i}" if i < 30 else "edited") for i in range(10, 60)]
    later = frame(spark, new, "file_path string, code_text string")
    changes = snapshot_diff(old, later, content="code_text").cache()
    upserts = exists_filter(later, changes.filter("change <> 'D'"))
    result = apply_changes(old, upserts, changes.filter("change = 'D'"))
    assert rows_of(result.select("file_path", "code_text")) == sorted(new)


@pytest.mark.parametrize(("upserts", "deletes"), [(3, 2), (0, 0)])
def test_apply_summary(spark, upserts, deletes):
    summary = apply_summary(spark.range(upserts), spark.range(deletes)).collect()
    assert [tuple(row) for row in summary] == [(upserts, deletes)]


def test_applying_changes_is_lazy_and_ranks_keys_only(spark):
    from pathlight.operators import apply_changes

    tracker = spark.sparkContext.statusTracker()
    index = spark.range(50).selectExpr("id", "concat('p', id) AS file_path", "'text' AS code_text")
    writes = spark.range(60).selectExpr("concat('p', id) AS file_path", "'new' AS code_text", "id AS seq")
    deletes = spark.range(3).selectExpr("concat('p', id) AS file_path")
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        changed = apply_changes(index, writes, deletes, order=["seq"], last_id=49)
        assert tracker.getJobIdsForGroup("lazy") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line and "_position" in line:
            assert "code_text" not in line
    rows = {r["file_path"]: r["id"] for r in changed.collect()}
    assert len(rows) == 60 and len(set(rows.values())) == 60
    assert rows["p10"] == 10 and min(rows[f"p{n}"] for n in (0, 1, 2, *range(50, 60))) == 50
