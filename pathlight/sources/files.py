"""Folders as tables: listing and reading files in tasks, whatever they are named.

Spark's own file sources pass over names that begin with ``_`` or ``.`` and over empty files; here nothing is left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import matches_any_glob
from ..session import scratch_dir, ship_package

# A tree deeper than this has folders that lead back into it.
MOST_LEVELS = 200

# Bytes of files that one task reads, and that it holds at a time; and what opening a file counts for.
TASK_BYTES, BATCH_BYTES, OPENING_BYTES = 128 << 20, 32 << 20, 64 << 10
# Longer files are not read but set aside: a value of a table has to fit into a task several times over.
MOST_FILE_BYTES = 512 << 20

# Why a file was not read.
TOO_LARGE, GONE, NOT_TEXT = "too large", "gone", "not UTF-8"

# Groups in which sizes are added up; one row for each comes together in a single task.
_SIZE_GROUPS = 1024

_LISTED = "file_path string, folder boolean, size bigint, mtime timestamp"
_LISTED_ARROW = pa.schema(
    [("file_path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC"))]
)
_READ = "file_path string, bytes binary, size bigint, mtime timestamp, unread string"
_READ_ARROW = pa.schema(
    [
        ("file_path", pa.string()), ("bytes", pa.binary()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC")),
        ("unread", pa.string()),
    ]
)


def qualified(root: str) -> str:
    """The address of a folder or file as all tasks understand it: a URI, or an absolute path."""
    if root.startswith("file:"):
        root = "/" + root[len("file:") :].lstrip("/")
    return root if "://" in root else os.path.abspath(root)


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified address and the path in it."""
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/") or "/"


def _list_folders(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    system, top = open_root(root)
    start = len(top.rstrip("/")) + 1
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            found = system.get_file_info(fs.FileSelector(f"{top}/{folder}" if folder else top))
            rows = [
                (x.path[start:], x.type == fs.FileType.Directory, x.size or 0, x.mtime or datetime.fromtimestamp(0, timezone.utc))
                for x in found
                if x.type in (fs.FileType.File, fs.FileType.Directory)
            ]
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LISTED_ARROW, strict=True)]
                yield pa.record_batch(columns, schema=_LISTED_ARROW)


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(file_path, size, mtime)`` of all files under ``root``, with paths relative to it.

    Folders are listed in tasks, level by level; each level is a table in the shared folder. ``glob`` is a pattern for
    the names of files. A root that does not exist is an error.
    """
    ship_package(spark)
    root = qualified(root)
    system, top = open_root(root)
    if system.get_file_info(top).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no such folder: {root}")
    where = scratch_dir(spark)
    folders = spark.range(1).select(F.lit("").alias("file_path"))
    for level in range(MOST_LEVELS):
        folders.mapInArrow(lambda batches: _list_folders(batches, root), _LISTED).write.parquet(f"{where}/level={level}")
        listed = spark.read.schema(_LISTED).parquet(f"{where}/level={level}")
        folders = listed.filter("folder").select("file_path")
        if folders.isEmpty():
            break
        folders = folders.repartition(spark.sparkContext.defaultParallelism)
    else:
        raise ValueError(f"more than {MOST_LEVELS} levels of folders under {root}")
    files = spark.read.schema(f"{_LISTED}, level int").option("basePath", where).parquet(where).filter("NOT folder")
    files = files.select("file_path", "size", "mtime")
    if glob:
        files = files.filter(matches_any_glob(F.substring_index("file_path", "/", -1), [glob]))
    return files


def _read_files(batches: Iterator[pa.RecordBatch], root: str, most: int) -> Iterator[pa.RecordBatch]:
    """Task body. A file that is too large, or gone since it was listed, is told with the reason; it does not end the run."""
    system, top = open_root(root)
    held: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _READ_ARROW, strict=True)]
        return pa.record_batch(columns, schema=_READ_ARROW)

    for batch in batches:
        for path, listed, mtime in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            data, why = None, TOO_LARGE
            if listed <= most:
                try:
                    with system.open_input_stream(f"{top}/{path}" if path else top, compression=None) as stream:
                        # It may have grown since it was listed.
                        data = stream.read(most + 1)
                    data, why = (data, None) if len(data) <= most else (None, TOO_LARGE)
                except FileNotFoundError:
                    why = GONE
            length = len(data or b"")
            if held and size + length > BATCH_BYTES:
                yield packed()
                held, size = [], 0
            held.append((path, data, listed, mtime, why))
            size += length
    if held:
        yield packed()


def packed_by_size(files: DataFrame, task_bytes: int = TASK_BYTES, most: int = MOST_FILE_BYTES) -> tuple[DataFrame, int]:
    """Listed files with the number of the task, ``pack``, that reads them, and how many tasks there are.

    The sizes of all files are laid end to end - in groups by the hash of the path, which one after the other begin where the last
    one ends - and cut where a task is full. So tasks differ by one file at most. A file too large to be read counts as empty.
    """
    read = F.when(F.col("size") <= most, F.col("size")).otherwise(0) + OPENING_BYTES
    grouped = files.withColumns({"_group": F.pmod(F.xxhash64("file_path"), F.lit(_SIZE_GROUPS)), "_weight": read})
    totals = grouped.groupBy("_group").agg(F.sum("_weight").alias("_total"))
    earlier = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_group", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    total = totals.agg(F.sum("_total")).first()[0] or 0
    slots = files.sparkSession.sparkContext.defaultParallelism
    # Small corpora are dealt over all slots.
    tasks = max(slots, -(-total // task_bytes))
    within = F.sum("_weight").over(Window.partitionBy("_group").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1))
    place = F.col("_start") + F.coalesce(within, F.lit(0))
    pack = F.least(F.floor(place * tasks / F.lit(max(total, 1))), F.lit(tasks - 1)).cast("int")
    placed = grouped.join(F.broadcast(starts), "_group").withColumn("pack", pack)
    return placed.select(*files.columns, "pack"), tasks


def read_files(
    files: DataFrame, root: str, task_bytes: int = TASK_BYTES, most: int = MOST_FILE_BYTES
) -> DataFrame:
    """``(file_path, bytes, size, mtime, unread)`` of listed files. Tasks read about ``task_bytes`` each.

    ``bytes`` is NULL for a file of more than ``most`` bytes and for one that has gone since; ``unread`` says why.
    """
    spark, root = files.sparkSession, qualified(root)
    ship_package(spark)
    packs, tasks = packed_by_size(files.select("file_path", "size", "mtime"), task_bytes, most)
    dealt = packs.repartitionById(tasks, "pack").drop("pack")
    return dealt.mapInArrow(lambda batches: _read_files(batches, root, most), _READ)


def read_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The lines of one text file as ``value``, whatever its name; None if there is no such file."""
    path = qualified(path)
    system, place = open_root(path)
    if system.get_file_info(place).type != fs.FileType.File:
        return None
    one = spark.range(1).select(F.lit("").alias("file_path"), F.lit(0).cast("bigint").alias("size"), F.current_timestamp().alias("mtime"))
    ship_package(spark)
    data = one.mapInArrow(lambda batches: _read_files(batches, path, MOST_FILE_BYTES), _READ)
    text = F.col("bytes").cast("string")
    return data.select(F.explode(F.split(text, "\r\n|\r|\n")).alias("value"))


def _write_files(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    system, top = open_root(root)
    written = 0
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system.create_dir(f"{top}/{path}".rpartition("/")[0])
            with system.open_output_stream(f"{top}/{path}") as stream:
                stream.write(content)
            written += 1
    yield pa.record_batch({"files": pa.array([written], pa.int64())})


def write_files(files: DataFrame, root: str) -> int:
    """Write ``(file_path, bytes)`` rows as files under ``root``, in tasks; returns how many. Paths must be unique."""
    ship_package(files.sparkSession)
    root = qualified(root)
    counts = files.select("file_path", "bytes").mapInArrow(lambda batches: _write_files(batches, root), "files bigint")
    return counts.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
