"""Near-duplicates by SimHash fingerprints and BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import LOWER_BYTES, pick_rows, row_key, staged

SHINGLE_WORDS = 4
RADIUS = 4
HASH_SEED = 42

# Fingerprints within the radius agree in at least BLOCKS - RADIUS of BLOCKS pieces: one table per choice of pieces.
BLOCKS = 6
# Fingerprints in one tree; a bucket that holds more has several trees.
TREE_SIZE = 2048

_HASHES_AT_ONCE = 1 << 16


def simhash(text: str | None, width: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Bit i is 1 if it is set in more than half of the shingle hashes; 0 for a text without words."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - width + 1)
    pairs = zip(starts[:count].tolist(), ends[-count:].tolist(), strict=True)
    digest, ones, taken = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    while taken < count:
        some = min(_HASHES_AT_ONCE, count - taken)
        hashes = np.array([digest(joined[a:b], seed) for a, b in _first(pairs, some)], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(some, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        taken += some
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def _first(pairs, some):
    for _ in range(some):
        yield next(pairs)


@F.arrow_udf(T.LongType())
def _simhash_column(texts: pa.Array) -> pa.Array:
    values = np.fromiter((simhash(text.as_py()) for text in texts), np.uint64, len(texts))
    return pa.array(values.view(np.int64))


class BkTree:
    """Fingerprints in a tree where a child hangs under its parent by its Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = len(self.values) - 1
                return
            at = below

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of all values within the radius. Only edges whose length is within it can lead to one."""
        found, pending = [], [0] if self.values else []
        while pending:
            at = pending.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            for length, child in self.children[at].items():
                if distance - radius <= length <= distance + radius:
                    pending.append(child)
        return found


def linked(trees: list[int], asking: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links from ``asking`` into the tree of ``trees``: a forest of them.

    With ``asking`` empty, the links inside ``trees``.
    """
    own = not asking
    tree, values = BkTree(), trees if own else trees + asking
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    if not own:
        for value in trees:
            tree.add(value)
    for i in range(0 if own else len(trees), len(values)):
        for j in tree.near(values[i], radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((values[i], values[j]))
        if own:
            tree.add(values[i])
    return links


def _link_runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Task body over rows (table, key, low, high, shard, fingerprint) sorted by the first five: links of every cell.

    Cells of one fingerprint - nearly all - are dropped by comparing neighbours in numpy.
    """
    names = ("_table", "_key", "_low", "_high")
    held: tuple | None = None
    shards: list[int] = []
    values: list[int] = []

    def cell() -> list[tuple[int, int]]:
        if held is None or len(values) < 2:
            return []
        low, high = held[2], held[3]
        if low == high:
            return linked(values, [], radius)
        one = [v for s, v in zip(shards, values, strict=True) if s == low]
        other = [v for s, v in zip(shards, values, strict=True) if s == high]
        return linked(one, other, radius) if one and other else []

    out: list[tuple[int, int]] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(name)) for name in names]
        shard, value = np.asarray(batch.column("_shard")), np.asarray(batch.column("fp")).view(np.uint64)
        new = np.zeros(len(batch), dtype=bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        new[0] = held is None or tuple(int(c[0]) for c in columns) != held
        starts = np.flatnonzero(new)
        # Rows before the first start go on with the cell that is held.
        head = starts[0] if len(starts) else len(batch)
        shards += shard[:head].tolist()
        values += value[:head].tolist()
        # No start: the whole batch goes on with the cell that is held.
        ends = np.append(starts[1:], len(batch))[: len(starts)]
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            last = end == len(batch)
            if end - start == 1 and not last:
                if held is not None:
                    out += cell()
                    held = None
                continue
            out += cell()
            held = tuple(int(c[start]) for c in columns)
            shards, values = shard[start:end].tolist(), value[start:end].tolist()
        if len(out) >= 50_000:
            yield _link_batch(out)
            out = []
    out += cell()
    if out:
        yield _link_batch(out)


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, dtype=np.uint64).view(np.int64)
    return pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def near_links(
    fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE
) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` that connect all that lie within the radius.

    The 64 bits are cut into ``blocks`` pieces. Two fingerprints within the radius agree in at least ``blocks - radius``
    pieces, so they meet in the bucket of at least one choice of pieces. Every bucket has BK-trees of at most
    ``tree_size`` fingerprints; a larger bucket has several, and its fingerprints ask each of them, in a task per pair of
    trees. A tree goes by shuffle to the tasks that ask it. Out of a cell comes a forest of links, never all pairs.
    """
    ship_package(fingerprints.sparkSession)
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    tables = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        key = F.col("fp").bitwiseAND(F.lit(signed).cast("bigint"))
        tables.append(F.struct(F.lit(number).alias("_table"), key.alias("_key")))
    buckets = fingerprints.select("fp", F.inline(F.array(*tables)))
    crowded = buckets.groupBy("_table", "_key").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > tree_size)
    trees = F.coalesce(F.ceil(F.col("_rows") / tree_size).cast("int"), F.lit(1))
    placed = (
        buckets.join(crowded, ["_table", "_key"], "left")
        .withColumn("_trees", trees)
        .withColumn("_shard", F.pmod(F.xxhash64("fp"), F.col("_trees")).cast("int"))
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_trees") - 1))
    cells = placed.withColumn("_other", other).select(
        "_table",
        "_key",
        F.least("_shard", "_other").alias("_low"),
        F.greatest("_shard", "_other").alias("_high"),
        "_shard",
        "fp",
    )
    place = ["_table", "_key", "_low", "_high"]
    dealt = cells.repartition(*place).sortWithinPartitions(*place, "_shard", "fp")
    return dealt.mapInArrow(lambda batches: _link_runs(batches, radius), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``(fp, root)``: the smallest fingerprint reachable from every linked one.

    Every round takes the smallest label among the neighbours and then the label of that label, so that paths shrink by
    half or more; it is written to the shared folder. Ends when no label changes.
    """
    both = links.select(F.col("a").alias("fp"), F.col("b").alias("other")).union(
        links.select(F.col("b").alias("fp"), F.col("a").alias("other"))
    )
    edges = staged(both.distinct(), "edges")
    labels = staged(edges.groupBy("fp").agg(F.least("fp", F.min("other")).alias("root")), "labels")
    while True:
        seen = labels.select(F.col("fp").alias("other"), F.col("root").alias("_root"))
        lowest = edges.join(seen, "other").groupBy("fp").agg(F.min("_root").alias("_root"))
        taken = labels.join(lowest, "fp").select("fp", F.col("root").alias("_old"), F.least("root", "_root").alias("root"))
        taken = staged(taken, "taken")
        jumps = taken.select(F.col("fp").alias("root"), F.col("root").alias("_next"))
        jumped = taken.join(jumps, "root", "left").select(
            "fp", "_old", F.least("root", F.coalesce("_next", "root")).alias("root")
        )
        jumped = staged(jumped, "labels")
        labels = jumped.select("fp", "root")
        if jumped.filter("_old <> root").limit(1).count() == 0:
            return labels


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, doc_id, fp)``: the SimHash of every text as a signed 64-bit number. NULL and texts without words have 0."""
    ship_package(docs.sparkSession)
    key = row_key(doc_id, F.col(text)).alias("key")
    return docs.select(key, F.col(doc_id).alias("doc_id"), _simhash_column(F.col(text)).alias("fp"))


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, doc_id, fp, root, component_id)`` of every row: documents whose fingerprints differ in at most ``radius`` bits are
    linked. ``component_id`` is the smallest id that links lead to, ``root`` the smallest fingerprint.

    Texts without words have fingerprint 0 and are linked like all others. Repeated rows and rows with one id and several
    texts are rows of their own. A NULL id is no smallest id unless there is no other. An empty table gives an empty result.
    """
    marked = staged(fingerprint(docs, doc_id, text), "fingerprints")
    # Copies are one fingerprint from here on; they are counted before the shuffle.
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    links = staged(near_links(distinct.select("fp"), radius), "links")
    rooted = distinct.join(components(links), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = staged(rooted.join(smallest, "root").select("fp", "root", "component_id"), "classes")
    return marked.join(classes, "fp", "left").select("key", "doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest id stays (then by its key)."""
    found = near_duplicates(docs, radius, doc_id, text)
    least = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    rows = found.groupBy("root", "key", "doc_id").agg(F.count("*").alias("_rows"))
    kept = rows.groupBy("root").agg(F.min_by(F.struct("key", F.col("_rows").alias("rows")), least).alias("kept"))
    return pick_rows(docs, staged(kept.select("kept.*", F.lit(1).alias("times")), "kept"), doc_id, text)


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
