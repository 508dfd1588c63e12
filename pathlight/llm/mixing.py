"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, number_within, pick_rows, row_key, staged

# Sources in code point order take these weights in turn, and stop at this multiple of what they hold.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)``: how much of each source a mix of the same total size takes.

    ``sizes`` has ``source`` and ``size``. Every source gets a share of the total by its weight, but at most
    ``max_epochs`` times what it holds; what is cut off goes to the others by weight, until none is above. The result is
    a common level: sources whose limit per weight lies under it stop there, all others get weight times the level. It is
    found with running sums over the sources ordered by that limit - one row per source, never rows of documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    )
    limited = totals.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * max_epochs)
    ratio = F.col("_limit") / F.col("_weight")
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        limited.withColumn("_ratio", ratio)
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.sum("_weight").over(onwards))
        # The first source that stays under its limit gives the level for itself and all after it.
        .withColumn("_stops", F.col("_ratio") <= F.col("_level"))
        .withColumn("_level", F.first(F.when(~F.col("_stops"), F.col("_level")), True).over(everything))
    )
    capped = F.col("_limit").cast("double")
    target = F.when(F.col("_level").isNull() | (F.col("_ratio") <= F.col("_level")), capped)
    return levels.select("source", "source_size", target.otherwise(F.col("_weight") * F.col("_level")).alias("target"))


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``(key, doc_id, source, size, source_size, target, copies)``, one row per document; ``key`` is its row key.

    ``size`` is the number of words. All documents of a source have the same expected number of copies, target / size of
    the source. Their prefix sums are taken in order of size, one random offset per source is added, and a document is
    emitted once for every integer it crosses. Ordered by size, neighbours stand for each other, so that the words taken
    lie within about one longest document of the target; no document has more than ``max_epochs`` copies.

    The result depends on the rows and ``seed`` only. NULL text has size 0; documents of size 0 take part like any
    others; NULL is a source of its own; repeated rows are rows of their own; an empty table gives an empty result.
    """
    rows = docs.select(
        row_key(doc_id, F.col(text)).alias("key"),
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    rows = staged(rows, "sizes")
    targets = source_targets(rows, weights, max_epochs)
    # 20 random bits: with them, sums of offset and prefix are exact enough for any number of rows.
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    offset = F.conv(F.substring(F.md5(name), 1, 5), 16, 10).cast("bigint") / F.lit(1 << 20)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumns({"_offset": offset, "_rate": rate})
    numbered = number_within(rows, "source", ["size", "doc_id", "key"], "_position", targets)
    upto = lambda n: F.floor(F.col("_offset") + n * F.col("_rate"))
    copies = (upto(F.col("_position") + 1) - upto(F.col("_position"))).cast("int")
    return numbered.select("key", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixed corpus: every document as often as the plan says, with all its columns."""
    wanted = plan.groupBy("key").agg(F.count("*").alias("rows"), F.sum("copies").cast("int").alias("times"))
    return pick_rows(docs, staged(wanted.filter("times > 0"), "copies"), doc_id, text)
