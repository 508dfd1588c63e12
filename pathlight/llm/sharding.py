"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import named, number_within

# The shards that a cluster starts with, in racks and regions; those added later open regions of their own.
FIRST_SHARDS, RACKS_PER_REGION, SHARDS_PER_RACK = 16, 2, 4


@dataclass(frozen=True)
class Node:
    """A region, a rack or - without children - a shard. The name enters the draws, so it must never change."""

    name: str
    weight: float
    shard: int = -1
    children: tuple[Node, ...] = ()


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(child.weight for child in children), -1, tuple(children))


def shard_tree(
    shards: int,
    weights: dict[int, float] | None = None,
    start: int = FIRST_SHARDS,
    racks_per_region: int = RACKS_PER_REGION,
    shards_per_rack: int = SHARDS_PER_RACK,
) -> Node:
    """The tree for a number of shards: the first ``start`` fill racks and regions, each later one opens its own region.

    Only subtrees whose weight changes take or lose rows. A shard that is added to an old rack would also draw rows to
    its neighbours there; one in a region of its own takes rows only into itself.
    """
    weight = lambda shard: float((weights or {}).get(shard, 1.0))
    per_region = racks_per_region * shards_per_rack
    regions: dict[int, dict[int, list[int]]] = {}
    for shard in range(shards):
        region = shard // per_region if shard < start else start + shard
        rack = shard % per_region // shards_per_rack if shard < start else 0
        regions.setdefault(region, {}).setdefault(rack, []).append(shard)
    return inner(
        "",
        [
            inner(
                f"{region}",
                [
                    inner(f"{region}/{rack}", [Node(f"{region}/{rack}/{s}", weight(s), s) for s in members])
                    for rack, members in racks.items()
                ],
            )
            for region, racks in regions.items()
        ],
    )


_MASK = (1 << 64) - 1
_RESULTS = ("doc_id", "size", "text_crc32", "shard", "grown_shard", "slot")


def _mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of the input over the output."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _name_seed(name: str, seed: int) -> int:
    value = (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
    for byte in name.encode():
        value = ((value ^ byte) * 0x100000001B3) & _MASK
    return value


def descend(keys: np.ndarray, tree: Node, seed: int) -> np.ndarray:
    """The shard of every key. At each level a child draws -ln(u) / weight and the smallest draw wins.

    The draw of a child depends on the key, its own name and its own weight. So when weights change, a key moves only
    into a subtree that became heavier or out of one that became lighter.
    """
    result = np.empty(len(keys), dtype=np.int32)
    pending = [(tree, np.arange(len(keys)))]
    while pending:
        node, rows = pending.pop()
        if not node.children:
            result[rows] = node.shard
            continue
        best = np.full(len(rows), np.inf)
        chosen = np.zeros(len(rows), dtype=np.int64)
        for number, child in enumerate(node.children):
            if child.weight <= 0:
                continue
            mixed = _mix(keys[rows] ^ np.uint64(_name_seed(child.name, seed)))
            draw = -np.log((mixed >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / child.weight
            nearer = draw < best
            best[nearer], chosen[nearer] = draw[nearer], number
        for number, child in enumerate(node.children):
            part = rows[chosen == number]
            if len(part):
                pending.append((child, part))
    return result


def shard_of(key: Column, tree: Node, seed: int = 42) -> Column:
    """The shard of a row by its key alone; NULL is a key like any other."""

    @F.arrow_udf("int")
    def draw(hashes: pa.Array) -> pa.Array:
        return pa.array(descend(np.asarray(hashes).astype(np.int64).view(np.uint64), tree, seed))

    return draw(F.xxhash64(key))


def assign_shards(
    docs: DataFrame,
    shards: int = 16,
    weights: dict[int, float] | None = None,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, grown_shard, slot)`` of every row, and the columns named by ``carry`` (one that
    has the name of a result gives way to it).

    ``shard`` is drawn from the id alone, ``grown_shard`` with one shard more. ``size`` is the UTF-8 length plus 1,
    ``text_crc32`` that of the text, where NULL counts as empty. Slots count from 0 in every shard, ordered by id and then
    crc and size; repeated rows get a slot each; an empty table gives an empty result. No shard is brought into one task.
    """
    ship_package(docs.sparkSession)
    bytes_of = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(bytes_of) + 1).cast("bigint").alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
        *named([name for name in carry if name not in _RESULTS]),
    )
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), shard_tree(shards, weights), seed)).withColumn(
        "grown_shard", shard_of(F.col("doc_id"), shard_tree(shards + 1, weights), seed)
    )
    return number_within(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
