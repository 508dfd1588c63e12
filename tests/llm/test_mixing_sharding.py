import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pathlight.llm import mixing, sharding

from .conftest import records


def targets_by_rounds(sizes, weights, cap):
    """Shares by weight, what is above a limit dealt out again until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] >= cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}
        if len(fixed) == len(names):
            return fixed


def test_targets_equal_repeated_sharing(spark):
    random = np.random.default_rng(1)
    sizes = {f"s{n}": int(v) for n, v in enumerate(random.pareto(0.7, 20) * 50)} | {None: 40, "z": 0}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in records(mixing.source_targets(frame))}
    want = targets_by_rounds(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    random = np.random.default_rng(2)
    rows = [(n, "w " * int(random.integers(1, 60)), "hot" if n % 3 else f"s{n % 7}") for n in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    plan = records(mixing.mix_plan(docs))
    taken, target = Counter(), {}
    for row in plan:
        taken[row["source"]] += row["copies"] * row["size"]
        target[row["source"]] = row["target"]
        assert 0 <= row["copies"] <= mixing.MAX_EPOCHS
    assert all(abs(taken[s] - target[s]) <= 2 * 60 for s in target)
    again = {r["doc_id"]: r["copies"] for r in records(mixing.mix_plan(docs.repartition(3)))}
    assert again == {r["doc_id"]: r["copies"] for r in plan}


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    plan = mixing.mix_plan(odd_docs)
    rows = records(plan)
    assert len(rows) == odd_docs.count()
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    mixed = mixing.emit(odd_docs, plan)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.emit(no_docs, mixing.mix_plan(no_docs)).count() == 0


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64)
    before = sharding.descend(keys, sharding.shard_tree(16), 42)
    for shards in (17, 18):
        after = sharding.descend(keys, sharding.shard_tree(shards), 42)
        moved = before != after
        assert set(after[moved]) == {shards - 1}
        assert 0.7 < moved.mean() * shards < 1.3
        before = after
    counts = np.bincount(before)
    assert counts.min() > 0.8 * counts.mean()


def test_a_heavier_shard_moves_rows_within_its_subtree_and_to_it():
    keys = np.random.default_rng(4).integers(0, 2**63, 20_000).astype(np.uint64)
    before = sharding.descend(keys, sharding.shard_tree(16), 42)
    after = sharding.descend(keys, sharding.shard_tree(16, {5: 3.0}), 42)
    moved = before != after
    # Shard 5 is in region 0, so nothing moves into or inside region 1.
    assert set(after[moved]) <= set(range(8))
    assert (after == 5).sum() > 2 * (before == 5).sum()


def plain_shard(doc_id, shards):
    """One row at a time: at every level the child with the smallest draw."""
    node, key = sharding.shard_tree(shards), XXH64(doc_id)
    while node.children:
        draws = []
        for child in node.children:
            value = key ^ sharding._name_seed(child.name, 42)
            value = (value ^ value >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            value = (value ^ value >> 27) * 0x94D049BB133111EB % 2**64
            value ^= value >> 31
            draws.append(-math.log((value >> 11) * 2.0**-53 + 2.0**-54) / child.weight)
        node = node.children[draws.index(min(draws))]
    return node.shard


def XXH64(number):  # noqa: N802
    return xxhash.xxh64_intdigest(number.to_bytes(8, "little", signed=True), 42)


def test_every_row_by_itself(spark):
    """The law of the query, row by row: shard and grown shard by the id, slots by counting."""
    texts = {n: None if n % 7 == 0 else "é" * (n % 13) for n in range(-20, 400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    slots = Counter()
    for r in sorted(records(sharding.assign_shards(docs)), key=lambda r: r["doc_id"]):
        text = (texts[r["doc_id"]] or "").encode()
        want = (len(text) + 1, zlib.crc32(text), plain_shard(r["doc_id"], 16), plain_shard(r["doc_id"], 17))
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == want
        assert r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
    assert sum(slots.values()) == len(texts)


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = records(sharding.assign_shards(odd_docs, carry=["text", "lang", "size", "shard"]))
    assert len(rows) == odd_docs.count()
    slots = defaultdict(list)
    for r in rows:
        text = (r["text"] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.assign_shards(no_docs).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_shards_depend_on_ids_only(spark, partitions):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(partitions)
    got = {(r["doc_id"], r["shard"], r["slot"]) for r in records(sharding.assign_shards(docs))}
    assert len(got) == 500
    want = {(r["doc_id"], r["shard"], r["slot"]) for r in records(sharding.assign_shards(docs.coalesce(1)))}
    assert got == want
