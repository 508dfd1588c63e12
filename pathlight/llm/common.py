"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

# The byte table that lower-cases A-Z and nothing else, and the same for column expressions.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

# Fixed value: words are runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def named(names: Sequence[str]) -> list[Column]:
    """Columns by their whole names, which may hold dots and backticks."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(rows: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write rows to the shared folder and read them back: computed once, and safe from the loss of an executor."""
    path = f"{scratch_dir(rows.sparkSession)}/{name}"
    rows.write.parquet(path, compression=compression)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def row_key(doc_id: str, text: Column) -> Column:
    """Never NULL, and equal for rows with the same id and text only (a repeated row is the same row)."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.hex(F.xxhash64(text)))


def pick_rows(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` named by ``wanted`` (``key, rows, times``), each ``times`` times, with the columns of ``docs``.

    ``key`` is :func:`row_key` and ``rows`` how often it occurs in ``docs``; a repeated row is taken as one.
    """
    keyed = docs.withColumn("_llm_key", row_key(doc_id, F.col(text)))
    asked = wanted.select(F.col("key").alias("_llm_key"), "rows", F.col("times").alias("_llm_times"))
    found = keyed.join(asked.filter("rows = 1").drop("rows"), "_llm_key")
    repeated = asked.filter("rows > 1").drop("rows")
    if repeated.limit(1).count():
        found = found.unionByName(keyed.join(repeated, "_llm_key").dropDuplicates(["_llm_key"]))
    copies = F.explode(F.sequence(F.lit(1), F.col("_llm_times"))).alias("_llm_copy")
    return found.select(*named(docs.columns), copies).drop("_llm_copy")


def number_within(
    rows: DataFrame, group: str, order: Sequence[str], position: str, per_group: DataFrame | None = None
) -> DataFrame:
    """Number the rows of every group from 0 in the given order, without bringing a group into one task.

    Rows are dealt by ranges of (group, order) and written with their partition and place; the starts of each group in
    each partition - a short table - then turn places into positions. A NULL is a group of its own. ``per_group`` has
    one row per group, whose columns are added. Rows that agree in ``order`` are numbered in any order, so they should be
    alike.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = staged(
        ranged.withColumns({"_llm_part": F.spark_partition_id(), "_llm_place": F.monotonically_increasing_id()}), "placed"
    )
    earlier = Window.partitionBy(group).orderBy("_llm_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_llm_part", group)
        .agg(F.min("_llm_place").alias("_llm_first"), F.count("*").alias("_llm_rows"))
        .withColumn("_llm_shift", F.coalesce(F.sum("_llm_rows").over(earlier), F.lit(0)) - F.col("_llm_first"))
        .select(F.col("_llm_part").alias("_llm_p"), F.col(group).alias("_llm_g"), "_llm_shift")
    )
    extra = []
    if per_group is not None:
        extra = [name for name in per_group.columns if name != group]
        added = per_group.withColumnRenamed(group, "_llm_h")
        starts = starts.join(added, F.col("_llm_g").eqNullSafe(F.col("_llm_h")), "left").drop("_llm_h")
    same = (F.col("_llm_part") == F.col("_llm_p")) & F.col(group).eqNullSafe(F.col("_llm_g"))
    return placed.join(starts, same, "left").select(
        *named(rows.columns), *extra, (F.col("_llm_place") + F.col("_llm_shift")).alias(position)
    )
