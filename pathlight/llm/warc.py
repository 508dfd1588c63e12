"""Web archives, compressed record by record with a dictionary that leads the file, and how they are read back."""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, ship_package
from .common import staged

# Payloads of fewer bytes are never deduplicated.
LEAST_BYTES = 100
# Payload bytes per archive. A single larger record has an archive of its own.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
# What a dictionary is built from: records spread over the archive, of each no more than this.
SAMPLE_BYTES, SAMPLE_PART = 2 << 20, 16 << 10
LEVEL = 3

# The frame type for a leading dictionary, the profile of a revisit, and the date every record bears.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: its header, an HTTP header and, unless it is a revisit, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive: a skippable frame with the dictionary, then a frame for every record."""
    step = max(1, sum(min(len(r), SAMPLE_PART) for r in records) // SAMPLE_BYTES)
    samples = [r[:SAMPLE_PART] for r in records[::step]]
    try:
        dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8)
    except (zstandard.ZstdError, ValueError):
        dictionary = None  # too few or too small records to build one from
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    leading = dictionary.as_bytes() if dictionary else b""
    frames = [struct.pack("<II", DICTIONARY_FRAME, len(leading)), leading]
    frames += [compressor.compress(r) for r in records]
    return b"".join(frames)


def unpack(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    kind, size = struct.unpack_from("<II", archive)
    if kind != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    dictionary = zstandard.ZstdCompressionDict(archive[8 : 8 + size]) if size else None
    body = io.BytesIO(archive)
    body.seek(8 + size)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(body, read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 16)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield headers, block


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Task body. Rows come in a fixed order, so another attempt writes the same files again; a move makes one appear whole."""
    target, root = fs.FileSystem.from_uri(folder)
    task = TaskContext.get().partitionId()
    held: list[bytes] = []
    size, number = 0, 0

    def flush() -> pa.RecordBatch:
        name = f"part-{task:06d}-{number:06d}.warc.zst"
        draft = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
        data = pack(held)
        with target.open_output_stream(draft) as out:
            out.write(data)
        target.move(draft, posixpath.join(root, name))
        return pa.record_batch({"name": [name], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    for batch in batches:
        for row in range(len(batch)):
            page_id, url, html, digest, refers_to = (column[row].as_py() for column in batch.columns)
            payload = html.encode()
            if held and size + len(payload) > archive_bytes:
                yield flush()
                held, size, number = [], 0, number + 1
            held.append(record(page_id, url, payload, digest, refers_to, refers_to is not None))
            size += len(payload)
    if held:
        yield flush()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    number = lambda value: None if value is None else int(value)
    rows: list[tuple] = []
    for batch in batches:
        for content in batch.column(0):
            for headers, block in unpack(content.as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind = headers["WARC-Type"]
                size, digest = int(head.rpartition(b"Content-Length: ")[2]), headers["WARC-Payload-Digest"].partition(":")[2]
                if kind == "response":
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not what was written")
                url = headers.get("WARC-Target-URI")
                url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                rows.append((number(headers.get("X-Page-ID")), url, size, digest, kind, number(headers.get("X-Refers-To-Page-ID"))))
                if len(rows) == 10_000:
                    yield batch_of(rows)
                    rows = []
    if rows:
        yield batch_of(rows)


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = LEAST_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Write a record for every page into archives under ``folder`` and return their names, records and bytes.

    ``folder`` must be seen by all executors, under the same address, and be of a kind that Arrow's file systems open.
    Of equal payloads of at least ``least_bytes`` the one with the smallest page id is written, the others refer to it;
    repeated rows of that page are written again. Who refers to whom is found from ids and digests alone. NULL html is an
    empty payload, a NULL id is none to refer to unless there is no other - then its pages are written in full.
    """
    spark = pages.sparkSession
    ship_package(spark)
    target, root = fs.FileSystem.from_uri(folder)
    target.create_dir(root)
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    short = staged(rows.select("page_id", "digest", F.octet_length("html").alias("bytes")), "digests")
    long = short.filter(F.col("bytes") >= least_bytes)
    shared = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    revisits = (
        long.join(shared.select("digest", "first"), "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
        .select("page_id", F.col("digest").alias("_digest"), "first")
        .distinct()
    )
    same = rows["page_id"].eqNullSafe(revisits["page_id"]) & (F.col("digest") == F.col("_digest"))
    told = rows.join(revisits, same, "left").select(
        rows["page_id"], "url", "html", "digest", F.col("first").alias("refers_to")
    )
    # The join has dealt the pages by id and digest, if it moved them at all.
    dealt = told.sortWithinPartitions("page_id", "digest", "url")
    return dealt.mapInArrow(
        lambda batches: _write(batches, folder, archive_bytes), "name string, records bigint, bytes bigint"
    )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives under ``folder``. Responses are checked against their digest."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(_read, _SCHEMA)


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write the archives into the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{scratch_dir(spark)}/archives"
    written = staged(write_archives(pages, folder, **options), "written")
    if written.limit(1).count() == 0:
        return spark.createDataFrame([], _SCHEMA)
    return read_archives(spark, folder)
