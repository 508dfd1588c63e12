import pytest
from pyspark.sql import functions as F

from pathlight.operators import ignore_filter, route_changes
from pathlight.sources import (
    change_list,
    corpus_scan,
    path_list,
    paths_frame,
    read_change_list,
    read_ignore_rules,
    readable,
    spread,
    table_corpus,
)


def lines(spark, *values):
    return spark.createDataFrame([(value,) for value in values], "value string")


def routed(spark, *values, **options):
    rows = route_changes(change_list(lines(spark, *values)), **options).collect()
    return {change: sorted(r["file_path"] for r in rows if r["change"] == change) for change in "AMD"}


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "src" / "a b").mkdir(parents=True)
    (tmp_path / "main.py").write_bytes(b"x = 1\r\ny = 2\rz\n")
    (tmp_path / "src" / "a b" / "ü.md").write_text("héllo", encoding="utf-8")
    (tmp_path / "src" / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "empty.txt").write_text("")
    files = corpus_scan(spark, str(tmp_path))
    good, bad = readable(files)
    assert {row["file_path"]: row["content"] for row in good.collect()} == {
        "main.py": "x = 1\ny = 2\nz\n",
        "src/a b/ü.md": "héllo",
        "empty.txt": "",
    }
    assert [row["file_path"] for row in bad.collect()] == ["src/bad.txt"]
    assert {row["size"] for row in files.filter("file_path = 'main.py'").collect()} == {15}
    only = corpus_scan(spark, f"{tmp_path}/", glob="*.py")
    assert [row["file_path"] for row in only.collect()] == ["main.py"]


HIDDEN = ["pkg/__init__.py", "pkg/a.py", ".hidden.py", "_priv/b.py", ".git/x", "pkg/corpus/x/c.py", "corpus/pkg/corpus/d.py"]


@pytest.mark.parametrize("root", ["corpus", "./corpus", "corpus/", "../{name}/corpus", "{full}/corpus", "file:{full}/corpus", "file://{full}/corpus"])
def test_every_file_is_found_relative_to_its_root(spark, tmp_path, monkeypatch, root):
    for path in HIDDEN:
        (tmp_path / "corpus" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "corpus" / path).write_text(path)
    monkeypatch.chdir(tmp_path)
    files = corpus_scan(spark, root.format(name=tmp_path.name, full=tmp_path))
    assert {r["file_path"]: r["content"] for r in files.collect()} == {path: path for path in HIDDEN}


def test_a_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        corpus_scan(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert corpus_scan(spark, str(tmp_path / "empty")).count() == 0


def test_table_corpus_sets_bad_text_aside(spark):
    table = spark.sql("SELECT 'a' AS p, CAST(X'ff' AS STRING) AS t UNION ALL SELECT 'b', 'x\\r\\ny'")
    good, bad = readable(table_corpus(table, "p", "t"))
    assert [(r["file_path"], r["content"]) for r in good.collect()] == [("b", "x\ny")]
    assert [r["file_path"] for r in bad.collect()] == ["a"]


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(100, numPartitions=16)
    assert spread(wide, "id") is wide
    narrow = spark.range(100, numPartitions=1)
    assert spread(narrow, "id").rdd.getNumPartitions() == 4
    assert spread(narrow, "id").count() == 100


def test_path_list(spark):
    frame = spark.createDataFrame([(1, " a.py\t./b//c.py \n d/ "), (2, ""), (3, None)], "i int, s string")
    rows = path_list(frame, "s").collect()
    assert [(r["i"], r["position"], r["file_path"]) for r in rows] == [(1, 0, "a.py"), (1, 1, "b/c.py"), (1, 2, "d")]


def test_paths_frame(spark):
    assert [r[0] for r in paths_frame(spark, "a ./b").collect()] == ["a", "b"]
    assert [r[0] for r in paths_frame(spark, ["with space.py ", "x//y"]).collect()] == ["with space.py", "x/y"]
    assert paths_frame(spark, "").count() == 0
    assert paths_frame(spark, []).count() == 0


def test_added_files(spark):
    assert routed(spark, "A\tfile1.py", "A\tfile2.cpp") == {"A": ["file1.py", "file2.cpp"], "M": [], "D": []}


def test_mixed_changes(spark):
    out = routed(spark, "A\tnew.py", "M\tmodified.py", "D\tdeleted.py")
    assert out == {"A": ["new.py"], "M": ["modified.py"], "D": ["deleted.py"]}


def test_no_changes(spark):
    assert routed(spark, "", "no-tab", "A") == {"A": [], "M": [], "D": []}


def test_renames_copies_and_type_changes(spark):
    raw = ["R100\told.py\tnew.py", "C75\tsrc.py\tcopy.py", "T\tlink", "U\tx", "X\ty"]
    assert routed(spark, *raw) == {"A": ["copy.py", "new.py"], "M": ["link"], "D": ["old.py"]}
    assert routed(spark, *raw, expand=False) == {"A": [], "M": [], "D": []}


def test_read_change_list(spark, tmp_path):
    path = tmp_path / ".changes.txt"
    path.write_text("A\ta.py\n\nR090\tx\ty\n")
    rows = sorted(tuple(row) for row in read_change_list(spark, str(path)).collect())
    assert rows == [("A", "a.py", None), ("R090", "x", "y")]


@pytest.mark.parametrize("name", ["rules", ".rules", "_rules"])
def test_read_ignore_rules(spark, tmp_path, name):
    path = tmp_path / name
    path.write_text("# comment\n*.py\n  build/ \n\n   # another\n")
    assert [r["rule"] for r in read_ignore_rules(spark, str(path)).collect()] == ["*.py", "build/"]


def test_missing_rule_file_means_no_rules(spark, tmp_path):
    assert read_ignore_rules(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("as_frame", [False, True])
def test_ignored_files(spark, as_frame):
    files = spark.createDataFrame([(p,) for p in ("main.py", "utils.cpp", "test.py", "build/script.sh")], "file_path string")
    rules = ["*.py", "build/*"]
    if as_frame:
        rules = spark.createDataFrame([(r,) for r in rules], "rule string")
    assert [r["file_path"] for r in ignore_filter(files, rules).collect()] == ["utils.cpp"]


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_a_cluster_needs_a_shared_folder(master):
    from types import SimpleNamespace

    from pathlight.session import scratch_dir

    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: default))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        scratch_dir(session)


def test_files_are_packed_by_size(spark, tmp_path):
    from pathlight.sources import list_files
    from pathlight.sources.files import OPENING_BYTES, packed_by_size

    sizes = [1, 700_000, 0, 2_500_000, 40_000, 900_000, 3_000_000, 10] * 12
    listed = spark.createDataFrame([(f"f{n}", size) for n, size in enumerate(sizes)], "file_path string, size bigint")
    packs, tasks = packed_by_size(listed, task_bytes=4_000_000)
    read = {r["pack"]: r["total"] for r in packs.groupBy("pack").agg(F.sum(F.col("size") + OPENING_BYTES).alias("total")).collect()}
    assert set(read) <= set(range(tasks)) and len(read) >= tasks - 3
    mean = sum(read.values()) / tasks
    assert max(read.values()) <= mean + 3_000_000 + OPENING_BYTES and packs.count() == len(sizes)
    for n in range(40):
        (tmp_path / f"x{n}").write_bytes(b"a" * (n * 1000))
    parts = corpus_scan(spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.sum("size").alias("s"))
    assert sum(r["s"] for r in parts.collect()) == sum(n * 1000 for n in range(40))
    assert list_files(spark, str(tmp_path)).count() == 40


def test_files_too_large_or_gone_are_set_aside(spark, tmp_path):
    from pathlight.sources import list_files, read_files

    (tmp_path / "a").write_text("text")
    (tmp_path / "bad").write_bytes(b"\xff\xfe")
    with open(tmp_path / "huge", "wb") as sparse:
        sparse.truncate(3 << 30)
    rows = {r["file_path"]: (r["content"], r["unread"], r["size"]) for r in corpus_scan(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("text", None, 4), "bad": (None, "not UTF-8", 2), "huge": (None, "too large", 3 << 30)}
    assert {r["file_path"] for r in readable(corpus_scan(spark, str(tmp_path)))[1].collect()} == {"bad", "huge"}
    listed = list_files(spark, str(tmp_path))
    (tmp_path / "a").unlink()
    assert {r["file_path"]: r["unread"] for r in read_files(listed, str(tmp_path)).collect()} == {"a": "gone", "bad": None, "huge": "too large"}
    small = {r["file_path"]: r["unread"] for r in corpus_scan(spark, str(tmp_path), most=1).collect()}
    assert small == {"bad": "too large", "huge": "too large"}
