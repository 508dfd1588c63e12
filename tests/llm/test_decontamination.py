import random
import re

from pathlight.llm import decontamination

from .conftest import records

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def slow(text, items):
    spoken, hit, found = words(text), set(), set()
    for item, content in items:
        own = words(content)
        size = min(13, len(own))
        for start in range(len(own) - size + 1) if own else ():
            for at in range(len(spoken) - size + 1):
                if spoken[at : at + size] == own[start : start + size]:
                    hit |= set(range(at, at + size))
                    found.add("" if item is None else str(item))
    return len(spoken), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(spoken)


def check(spark, docs, items, **options):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for row in records(decontamination.contamination(docs, benchmark, **options).join(docs.select("doc_id", "text").distinct(), "doc_id")):
        got = row["n_words"], row["n_hit"], row["items"], row["contaminated"]
        assert got == slow(row["text"], items), row["doc_id"]
        assert row["n_items"] == len(row["items"])


def test_against_brute_force(spark):
    draw = random.Random(5)
    some = lambda n: [draw.choice(["the", "of", "Rare", "a", "x1", "Éa", "éa", "É", "K"]) for _ in range(n)]
    items = [(n, draw.choice([" ", ", ", "--"]).join(some(draw.choice([1, 2, 5, 12, 13, 14, 30])))) for n in range(12)]
    items += [(3, items[3][1]), (50, items[3][1]), (51, ""), (52, None), (None, "odd one out here"), (53, "--!--")]
    docs = []
    for n in range(60):
        text = some(draw.randrange(40))
        for _ in range(draw.randrange(3)):
            copied = words(draw.choice(items)[1])
            text[draw.randrange(len(text) + 1) : 0] = [w.upper() if n % 2 else w for w in copied]
        docs.append((n, "; ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    check(spark, frame, items)
    # In many rounds with small parts of the benchmark, the same.
    check(spark, frame, items, limit=1000)


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "the moon"), (2, None), (3, ""), (None, "Haus von dem Mann"), (4, "chat est")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = records(decontamination.contamination(odd_docs, benchmark))
    assert len(rows) == odd_docs.count()
    assert all(not r["contaminated"] and r["n_words"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    copies = [r for r in rows if r["doc_id"] in (1, 2) and r["n_hit"]]
    assert len(copies) == 3 and all(r["items"] == ["1"] and r["n_hit"] == 2 for r in copies)
    assert any(r["doc_id"] is None and r["items"] == [""] for r in rows)
    clean = decontamination.decontaminate(odd_docs, benchmark)
    assert clean.columns == odd_docs.columns and clean.count() == sum(not r["contaminated"] for r in rows)
    empty = benchmark.limit(0)
    assert decontamination.decontaminate(odd_docs, empty).count() == odd_docs.count()
    assert decontamination.contamination(no_docs, benchmark).count() == 0


def test_no_python_and_no_cross_join(spark, odd_docs):
    benchmark = spark.createDataFrame([(1, "the moon and the stars")], "item_id bigint, text string")
    plan = decontamination.contamination(odd_docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
