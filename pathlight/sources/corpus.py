"""Where files, change lists and rules come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import WHITESPACE, normalize_path, split_whitespace, strip, universal_newlines
from .files import MOST_FILE_BYTES, NOT_TEXT, list_files, read_files, read_lines


def corpus_scan(spark: SparkSession, root: str, glob: str | None = None, most: int = MOST_FILE_BYTES) -> DataFrame:
    """All files under ``root`` as ``(file_path, content, size, mtime, unread)``; paths are relative to ``root``.

    Names that begin with ``.`` or ``_`` and empty files are files like any others. ``content`` is NULL for a file that
    is not valid UTF-8, is longer than ``most`` bytes or has gone since it was listed, and ``unread`` says which: split with
    :func:`readable`. For paths alone use :func:`pathlight.sources.list_files`.
    """
    files = read_files(list_files(spark, root, glob), root, most=most)
    text = universal_newlines(F.try_validate_utf8(F.col("bytes").cast("string")))
    told = files.select("file_path", text.alias("content"), "size", "mtime", "unread")
    return told.withColumn("unread", F.coalesce("unread", F.when(F.col("content").isNull(), F.lit(NOT_TEXT))))


def table_corpus(table: DataFrame, file_path: Column | str, content: Column | str) -> DataFrame:
    """Any table as ``(file_path, content)``, with the same treatment of text as :func:`corpus_scan`."""
    path = F.col(file_path) if isinstance(file_path, str) else file_path
    text = F.col(content) if isinstance(content, str) else content
    return table.select(
        path.alias("file_path"), universal_newlines(F.try_validate_utf8(text)).alias("content")
    )


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan that yields fewer partitions than there are task slots, hashed over all slots; any other as it is.

    For small corpora in one file, whose texts would otherwise be parsed by a single task. A large corpus has more
    splits than slots and is never shuffled here. ``scan`` must be a plain scan with projections and filters.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= slots else scan.repartition(slots, key)


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a corpus into files with text and paths that could not be decoded."""
    return files.filter(F.col("content").isNotNull()), files.filter(F.col("content").isNull()).select("file_path")


def path_list(lists: DataFrame, column: str) -> DataFrame:
    """Whitespace-separated paths, one row each: the other columns, ``position`` from 0, ``file_path``."""
    rest = [name for name in lists.columns if name != column]
    return lists.select(*rest, F.posexplode(split_whitespace(column)).alias("position", "file_path")).withColumn(
        "file_path", normalize_path("file_path")
    )


def change_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated ``status<TAB>path[<TAB>new path]`` lines as ``(status, file_path, new_path)`` and other columns.

    Blank lines and lines of fewer than two fields are dropped.
    """
    rest = [name for name in lines.columns if name != column]
    return (
        lines.select(*rest, F.split(column, "\t").alias("_fields"))
        .filter(F.size("_fields") >= 2)
        .select(
            *rest,
            F.get("_fields", F.lit(0)).alias("status"),
            F.get("_fields", F.lit(1)).alias("file_path"),
            F.get("_fields", F.lit(2)).alias("new_path"),
        )
    )


def read_change_list(spark: SparkSession, path: str) -> DataFrame:
    lines = read_lines(spark, path)
    if lines is None:
        raise FileNotFoundError(f"no such file: {path}")
    return change_list(lines)


def ignore_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """Glob rules from raw lines: stripped, without blank lines and ``#`` comments. Column ``rule``, after any others."""
    rest = [name for name in lines.columns if name != column]
    return lines.select(*rest, strip(column).alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("#"))


def read_ignore_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file, whatever its name; a missing file means no rules."""
    lines = read_lines(spark, path)
    return ignore_rules(spark.createDataFrame([], "value string") if lines is None else lines)


def paths_frame(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """Paths given as a whitespace-separated string, a list (for paths with spaces) or a DataFrame."""
    if isinstance(paths, DataFrame):
        return path_normalized(paths)
    if isinstance(paths, str):
        return path_list(spark.createDataFrame([(paths,)], "value string"), "value").select("file_path")
    stripped = [(path.strip(WHITESPACE),) for path in paths]
    return path_normalized(spark.createDataFrame(stripped, "file_path string"))


def path_normalized(paths: DataFrame) -> DataFrame:
    return paths.select(normalize_path("file_path").alias("file_path"))
