import random
import re

import pyarrow as pa
import xxhash

from pathlight.llm import simhash

from .conftest import records

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {v: find(v) for v in values}


def test_tree_finds_all_within_the_radius():
    draw = random.Random(1)
    values = [draw.getrandbits(64) for _ in range(200)]
    values += [v ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for v in values]
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        for radius in (0, 2, 4, 30):
            assert sorted(tree.near(v, radius)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= radius]


def clusters(draw, groups, size):
    out = []
    for _ in range(groups):
        v = draw.getrandbits(64)
        for _ in range(size):
            out.append(v)
            for _ in range(draw.randrange(1, 6)):
                v ^= 1 << draw.randrange(64)
    return list(dict.fromkeys(out))


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def check_links(spark, values, tree_size):
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    links = simhash.near_links(frame, tree_size=tree_size)
    found = {r["fp"] % (1 << 64): r["root"] % (1 << 64) for r in records(simhash.components(links))}
    want = slow_components(values, simhash.RADIUS)
    groups = lambda of: {frozenset(v for v in values if of[v] == r) for r in set(of.values())}
    assert groups({v: found.get(v, v) for v in values}) == groups(want)


def test_links_connect_what_lies_within_the_radius(spark):
    check_links(spark, clusters(random.Random(2), 30, 8), simhash.TREE_SIZE)


def test_crowded_buckets_have_several_trees(spark):
    check_links(spark, clusters(random.Random(3), 2, 80), 16)


def test_a_cell_goes_on_over_whole_batches():
    values = [1, 3, 7, 15, 31, 63]
    rows = [(0, 5, 0, 0, 0, v) for v in values] + [(0, 6, 0, 0, 0, v << 40) for v in (1, 3)]
    names = ["_table", "_key", "_low", "_high", "_shard", "fp"]

    def links(cuts):
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names) for part in parts]
        return [(r["a"], r["b"]) for b in simhash._link_runs(iter(batches), 4) for r in b.to_pylist()]

    whole = links([])
    assert len(whole) == len(values) - 1 + 1
    # The second batch, then the second and the last, lie inside one cell.
    assert links([2, 4]) == links([2, 4, 7]) == links([1, 2, 3, 4, 5, 6, 7]) == whole


def test_a_long_chain_is_one_component(spark):
    value, values = 0, []
    for bit in range(60):
        value |= 1 << bit
        values.append(value)
    check_links(spark, values, simhash.TREE_SIZE)


def test_odd_rows(odd_docs, no_docs):
    rows = records(simhash.near_duplicates(odd_docs))
    texts = {(r["doc_id"], r["text"]) for r in records(odd_docs)}
    assert len(rows) == odd_docs.count()
    assert sorted((r["doc_id"] or -1, r["fp"] % (1 << 64)) for r in rows if r["doc_id"] != 1) == sorted(
        (i or -1, slow_fingerprint(t)) for i, t in texts if i != 1
    )
    by_id = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] not in (1, None)}
    # Copies; texts without words (the NULL ids among them).
    assert by_id[2] == 1 and by_id[3] == by_id[4] == by_id[5] == 3
    assert by_id[7] == 7 and by_id[10] == 10
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert len({r["root"] for r in rows}) == kept.count()
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
