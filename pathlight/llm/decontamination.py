"""Benchmark decontamination: a prefix-filtered set join of documents with the windows of benchmark items.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import lower_ascii, named, row_key, staged

WINDOW_WORDS = 13
# A document is contaminated when at least one word in so many is hit.
ONE_IN = 20

# Fixed value: what stands between words - ASCII other than letters and digits (A-Z count as letters before lower-casing).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# What is sent to every task at once. Larger benchmarks are met in several rounds, each of them a scan of the documents.
BROADCAST_BYTES = 16 << 20
# Per row of a sent table, besides its strings.
_ROW_BYTES = 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _slices(rows: DataFrame, size: Column, by: str, limit: int) -> list[DataFrame]:
    """Parts of a table that hold about ``limit`` bytes each, by hash, marked for broadcast."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = -(-total // limit)
    part = F.pmod(F.xxhash64(by), F.lit(max(parts, 1)))
    return [F.broadcast(rows.filter(part == n) if parts > 1 else rows) for n in range(parts)]


def item_windows(items: DataFrame, width: int = WINDOW_WORDS, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, len, words, window)``: every run of ``width`` words of every item; a shorter item is one window."""
    split = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("_all")).filter(F.size("_all") > 0)
    length = F.least(F.size("_all"), F.lit(width))
    start = F.explode(F.sequence(F.lit(0), F.size("_all") - length)).alias("_start")
    runs = split.select("item_id", "_all", length.alias("len"), start)
    words = F.slice("_all", F.col("_start") + 1, F.col("len"))
    return runs.select("item_id", "len", words.alias("words")).withColumn("window", _joined(F.col("words")))


def _joined(words: Column) -> Column:
    return lower_ascii(F.array_join(words, " "))


def probe_table(docs: DataFrame, windows: DataFrame, text: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``(wid, len, window, token, offset)``: every distinct window with its rarest word.

    The words of a window are ordered by how often they occur in the documents. A window is a set that must be contained
    whole, so its necessary prefix is one word - the first in that order. Counts are taken over all documents, for the
    words of the benchmark only. Here and in the join words are compared in lower case as a whole; the exact comparison
    follows.
    """
    distinct = staged(
        windows.groupBy("window", "len").agg(F.first("words").alias("words")).withColumn("wid", F.monotonically_increasing_id()),
        "windows",
    )
    placed = distinct.select("wid", F.posexplode("words").alias("offset", "_word")).withColumn("token", F.lower("_word"))
    vocabulary = placed.select("token").distinct()
    spoken = docs.select(F.explode(words_of(F.col(text))).alias("_word")).select(F.lower("_word").alias("_spoken"))
    counts = [
        spoken.join(some, F.col("_spoken") == F.col("token"), "left_semi").groupBy("_spoken").agg(F.count("*").alias("_times"))
        for some in _slices(staged(vocabulary, "vocabulary"), F.octet_length("token") + _ROW_BYTES, "token", limit)
    ]
    if not counts:
        return distinct.select("wid", "len", "window", F.lit("").alias("token"), F.lit(0).alias("offset"))
    times = staged(reduce(DataFrame.union, counts), "counts")
    rarity = F.struct(F.coalesce("_times", F.lit(0)).alias("times"), "offset", "token")
    rarest = (
        placed.join(times, F.col("token") == F.col("_spoken"), "left")
        .groupBy("wid")
        .agg(F.min(rarity).alias("_rarest"))
        .select("wid", "_rarest.token", "_rarest.offset")
    )
    return distinct.join(rarest, "wid").select("wid", "len", "window", "token", "offset")


def occurrences(
    docs: DataFrame, probes: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``(key, start, end, wid)``: every place where a window occurs in a document, ends exclusive, in words.

    Each word of a document that is the prefix of a window proposes one place for it. Places that would begin before the
    document or end after it are dropped, all others are compared word for word - inside the join, so that neither the
    words of a document nor mere candidates are ever shuffled.
    """
    split = docs.select(row_key(doc_id, F.col(text)).alias("key"), words_of(F.col(text)).alias("_words"))
    spoken = split.select("key", "_words", F.posexplode("_words").alias("_at", "_word"))
    start = F.col("_at") - F.col("offset")
    same = (
        (F.lower("_word") == F.col("token"))
        & (start >= 0)
        & (start + F.col("len") <= F.size("_words"))
        & (_joined(F.slice("_words", start + 1, F.col("len"))) == F.col("window"))
    )
    size = F.octet_length("window") + F.octet_length("token") + _ROW_BYTES
    found = [
        spoken.join(some, same).select("key", start.alias("start"), (start + F.col("len")).alias("end"), "wid")
        for some in _slices(probes, size, "wid", limit)
    ]
    if not found:
        return split.select("key", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("wid")).limit(0)
    return reduce(DataFrame.union, found)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW_WORDS,
    one_in: int = ONE_IN,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(key, doc_id, n_words, n_hit, n_items, items, contaminated)`` of every row of ``docs``.

    A word is hit if it lies inside any occurrence of a window; ``items`` lists the ids, as sorted strings, of the items
    with a window that occurs. NULL and empty texts have no words and are clean; items without words are never found;
    repeated rows get equal results; an item whose id is NULL is listed as an empty string; without items, or without
    documents, nothing is contaminated.
    """
    windows = staged(item_windows(benchmark, width, item_id, item_text), "item_windows")
    probes = staged(probe_table(docs, windows, text, limit), "probes")
    hits = staged(occurrences(docs, probes, doc_id, text, limit), "hits")
    # Words under several windows count once: each window adds what reaches beyond those that begin before it.
    earlier = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(earlier), F.col("start"))
    words_hit = (
        hits.groupBy("key", "start")
        .agg(F.max("end").alias("end"))
        .withColumn("_new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach)))
        .groupBy("key")
        .agg(F.sum("_new").alias("n_hit"))
    )
    owners = windows.join(probes.select("wid", "window", "len"), ["window", "len"]).select(
        "wid", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    )
    items_hit = (
        hits.select("key", "wid")
        .distinct()
        .join(owners.distinct(), "wid")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = words_hit.join(items_hit, "key")
    counted = docs.select(
        row_key(doc_id, F.col(text)).alias("key"),
        F.col(doc_id).alias("doc_id"),
        F.size(words_of(F.col(text))).cast("bigint").alias("n_words"),
    )
    none = F.array().cast("array<string>")
    return (
        counted.join(found, "key", "left")
        .withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", none)})
        .select(
            "key",
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("bigint").alias("n_items"),
            "items",
            ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    found = contamination(docs, benchmark, doc_id=doc_id, text=text, **options)
    dirty = staged(found.filter("contaminated").select(F.col("key").alias("_llm_key")).distinct(), "contaminated")
    return docs.withColumn("_llm_key", row_key(doc_id, F.col(text))).join(dirty, "_llm_key", "left_anti").select(*named(docs.columns))
