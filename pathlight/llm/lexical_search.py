"""Ranked lexical search by the Best Position Algorithm.

For every term of an item there is an impact list: the documents that hold the term, highest contribution first. The
algorithm reads each list at its best position - the one up to which all have been seen - by direct access, looks up new
documents in all other lists and marks their positions there as seen, too. No unseen document can score more than the sum
of what stands at the first unseen positions; once that is strictly below the k-th score so far, the search ends.

Documents are dealt in blocks, each with lists of its own; the best of every block are merged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import UPPER, staged

BEST = 50

# Fixed value: a term is a run of anything but ASCII that is neither letter nor digit.
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())

# Text of the items whose terms are sent to every task at once; more items go in several rounds.
ITEM_BYTES = 8 << 20
# Entries of the impact lists of one block of documents.
BLOCK_ENTRIES = 1_000_000
# Positions that a list is read ahead at first; twice as many each time.
FIRST_STEP = 64

_INDEXED = "doc_id {id}, n bigint, terms array<int>, times array<int>"


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


@dataclass
class Items:
    """Items of one round: their ids, and the distinct terms of each as numbers of a common vocabulary."""

    ids: pa.Array
    terms: list[np.ndarray]
    vocabulary: dict[str, int]


def _rounds(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[Items]:
    """Items in parts of about ``limit`` bytes of text, by hash; equal rows are one item."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    rows = staged(rows, "items")
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    parts = -(-size // limit)
    for number in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == number).toArrow()
        vocabulary: dict[str, int] = {}
        numbers = [
            np.array(sorted({vocabulary.setdefault(term, len(vocabulary)) for term in terms_of(value)}), np.int64)
            for value in part.column("text").to_pylist()
        ]
        yield Items(part.column("item_id").combine_chunks(), numbers, vocabulary)


def _count_terms(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Task body: ids and texts to ``n``, the number of terms, and how often those of the vocabulary occur."""
    for batch in batches:
        sizes, lengths, terms, times = [], [], [], []
        for text in batch.column(1):
            found = terms_of(text.as_py())
            sizes.append(len(found))
            before = len(terms)
            for term, count in Counter(found).items():
                number = vocabulary.get(term)
                if number is not None:
                    terms.append(number)
                    times.append(count)
            lengths.append(len(terms) - before)
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32())) for values in (terms, times)]
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])


class ImpactLists:
    """The impact lists of a block of documents, numbered by id, and for each document its places in them."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int) -> None:
        """Document ``d`` has the entries from ``starts[d]`` to ``starts[d + 1]``."""
        self.starts, self.terms, self.impacts = starts, terms, impacts
        docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.falling = docs[order], impacts[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.lists = np.searchsorted(terms[order], np.arange(vocabulary + 1))

    def best(self, wanted: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """``(documents, scores)``: the ``k`` best for the ``wanted`` terms that score at least ``floor``, ties by number."""
        begin, end = self.lists[wanted], self.lists[wanted + 1]
        held = end > begin
        wanted, begin, end = wanted[held], begin[held], end[held]
        asked = np.zeros(len(self.lists), bool)
        asked[wanted] = True
        seen = np.zeros(len(self.docs), bool)
        known = np.zeros(len(self.starts) - 1, bool)
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        position, step, limit = begin.copy(), FIRST_STEP, floor
        # What an unseen document can score at most, against the score it has to reach.
        while (position < end).any() and self.falling[position[position < end]].sum() >= limit:
            ahead = [self.docs[a : min(a + step, b)] for a, b in zip(position.tolist(), end.tolist(), strict=True) if a < b]
            new = np.concatenate(ahead)
            new = np.unique(new[~known[new]])
            known[new] = True
            docs = np.concatenate((docs, new))
            scores = np.concatenate((scores, self._look_up(new, asked, seen)))
            for i, (a, b) in enumerate(zip(position.tolist(), end.tolist(), strict=True)):
                unseen = seen[a:b]
                # The first position that has not been seen; argmin of all True is 0.
                jump = int(unseen.argmin()) if a < b else 0
                position[i] = b if a < b and unseen[jump] else a + jump
            if len(scores) >= k:
                limit = max(limit, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            step *= 2
        chosen = np.flatnonzero(scores >= limit)
        chosen = chosen[np.lexsort((docs[chosen], -scores[chosen]))][:k]
        return docs[chosen], scores[chosen]

    def _look_up(self, docs: np.ndarray, asked: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Scores of documents; their places in the lists asked are marked as seen."""
        first, counts = self.starts[docs], self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(counts)
        entries = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)
        counted = asked[self.terms[entries]]
        seen[self.place[entries[counted]]] = True
        running = np.concatenate(([0], np.cumsum(np.where(counted, self.impacts[entries], 0))))
        return running[ends] - running[ends - counts]


def _block(table: pa.Table, weights: np.ndarray) -> tuple[pa.Array, ImpactLists]:
    """Ids and impact lists of the documents ``(doc_id, m, terms, times)``, by ascending id, a NULL last."""
    order = pc.sort_indices(table.column("doc_id").combine_chunks(), null_placement="at_end")
    table = table.take(order).combine_chunks()
    lists = table.column("terms").combine_chunks()
    counts = np.asarray(lists.value_lengths()).astype(np.int64)
    terms = np.asarray(lists.flatten()).astype(np.int64)
    times = np.asarray(table.column("times").combine_chunks().flatten()).astype(np.int64)
    spread = np.repeat(np.asarray(table.column("m")).astype(np.int64), counts)
    impacts = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * spread))
    kept = impacts > 0
    owner = np.repeat(np.arange(len(counts)), counts)[kept]
    starts = np.searchsorted(owner, np.arange(len(counts) + 1))
    return table.column("doc_id").combine_chunks(), ImpactLists(starts, terms[kept], impacts[kept], len(weights))


def _search(
    batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, k: int, block_entries: int
) -> Iterator[pa.RecordBatch]:
    """Task body: ``(item, doc_id, score)``, the best of every block. What an item has k of already is not given again."""
    floors = np.ones(len(items.terms), np.int64)

    def searched(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists = _block(pa.Table.from_batches(block), weights)
        for number, wanted in enumerate(items.terms):
            docs, scores = lists.best(wanted, k, int(floors[number]))
            if len(docs) == k:
                floors[number] = scores[-1]
            if len(docs):
                item = pa.array(np.full(len(docs), number, np.int32))
                yield pa.record_batch([item, ids.take(pa.array(docs)), pa.array(scores)], ["item", "doc_id", "score"])

    held: list[pa.RecordBatch] = []
    entries = 0
    for batch in batches:
        held.append(batch)
        entries += len(batch) + len(batch.column(2).flatten())
        if entries >= block_entries:
            yield from searched(held)
            held, entries = [], 0
    if held:
        yield from searched(held)


def _ranked_items(docs: DataFrame, items: Items, k: int, id_type: str, block_entries: int) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` for the items of one round."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(items.vocabulary)
    indexed = staged(
        docs.mapInArrow(lambda batches: _count_terms(batches, vocabulary.value), _INDEXED.format(id=id_type)), "indexed"
    )
    documents, words = indexed.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    # One row for each term of the items, so the driver holds no more than it sent.
    held = indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double")))
    weights = np.zeros(len(items.vocabulary) + 1, np.int64)
    for row in held.select("term", weight.cast("bigint").alias("w")).collect():
        weights[row["term"]] = row["w"]
    # In 38 digits: long texts times many documents may pass 64 bits before the division.
    spread = F.call_function(
        "div", 50 * F.col("n").cast("decimal(12,0)") * F.lit(documents).cast("decimal(15,0)"), F.lit(words or 1).cast("decimal(20,0)")
    )
    asked = indexed.filter(F.size("terms") > 0).select("doc_id", (100 - 50 + spread).alias("m"), "terms", "times")
    sent = spark.sparkContext.broadcast((items, weights))
    found = asked.mapInArrow(
        lambda batches: _search(batches, *sent.value, k, block_entries), f"item int, doc_id {id_type}, score bigint"
    )
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Merged in parts first: no task sorts what all blocks found for an item.
    by_part = Window.partitionBy("item", "_part").orderBy(*order)
    parted = found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
    best = parted.withColumn("rank", F.row_number().over(by_part)).filter(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    names = pa.table({"item": pa.array(range(len(items.ids)), pa.int32()), "item_id": items.ids})
    named = spark.createDataFrame(names)
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    item_bytes: int = ITEM_BYTES,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item with a score above 0, ``rank`` from 1.

    A document without terms - NULL and empty texts among them - is not counted, an item without terms has no hits. Repeated
    documents, also with one id, are documents of their own; equal rows of ``items`` are one item, and rows with one id and
    several texts several. Equal scores go by ascending id, a NULL last. Empty tables give an empty result. Only ids and
    texts are read, so other columns may have any names. Documents are read once per round of items and their counts of the
    items' terms written; blocks of them are then searched where they lie, and only hits are shuffled.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = [_ranked_items(rows, part, k, id_type, block_entries) for part in _rounds(items, item_id, item_text, item_bytes)]
    if not found:
        return rows.select(
            F.lit(None).cast(items.schema[item_id].dataType).alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("bigint").alias("score")
        ).limit(0)
    return reduce(DataFrame.union, found)
