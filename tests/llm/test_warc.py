import hashlib
import struct

import pytest
import zstandard

from pathlight.llm import warc
from pathlight.session import scratch_dir

from .conftest import records

PAGES = [
    (1, "http://a.example/", "<p>" + "same page " * 30),
    (2, "http://b.example/", "<p>" + "same page " * 30),
    (3, "http://c.example/\r\nX: 1%0A", "<p>short"),
    (4, "http://d.example/", "<p>short"),
    (5, None, None),
    (6, "http://f.example/", ""),
    (7, "http://g.example/", "ä日本\U0001f600 \r\n\r\nWARC/1.1\r\n" * 40),
    (7, "http://g.example/", "ä日本\U0001f600 \r\n\r\nWARC/1.1\r\n" * 40),
    (8, "http://h.example/", "ä日本\U0001f600 \r\n\r\nWARC/1.1\r\n" * 40),
    (None, "http://i.example/", "<p>" + "same page " * 30),
    (None, "http://j.example/", "<p>" + "only without id " * 30),
    (9, "http://k.example/", "x" * 2_000_000),
]
SCHEMA = "page_id bigint, url string, html string, digest string, first bigint"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "d", 1) for p in PAGES], SCHEMA).repartition(3)


def want():
    out = []
    for page, url, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None] if len(data) >= 100 else []
        first = min(same, default=None)
        revisit = first is not None and page != first
        out.append((page, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [1000, warc.ARCHIVE_BYTES])
def test_round_trip(pages, archive_bytes):
    got = [tuple(r.values()) for r in records(warc.archive_and_read(pages, archive_bytes=archive_bytes))]
    assert sorted(got, key=repr) == want()


def test_rewriting_gives_the_same_files(spark, pages):
    listings = []
    for _ in range(2):
        folder = f"{scratch_dir(spark)}/archives"
        warc.write_archives(pages, folder).collect()
        files = spark.read.format("binaryFile").load(folder).select("path", "content").collect()
        listings.append(sorted((r["path"].rpartition("/")[2], hashlib.sha256(r["content"]).hexdigest()) for r in files))
    assert listings[0] == listings[1]


def test_dictionary_leads_and_records_stand_alone():
    made = [warc.record(n, f"http://x.example/{n}", (f"<p>page {n} " + "common words " * 20).encode(), "00", None, False) for n in range(400)]
    archive = warc.pack(made)
    kind, size = struct.unpack_from("<II", archive)
    assert kind == warc.DICTIONARY_FRAME and size > 0
    dictionary = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    # Every record is a frame that can be read with the dictionary alone.
    rest, frames = archive[8 + size :], 0
    while rest:
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        assert reader.decompress(rest) == made[frames]
        rest, frames = reader.unused_data, frames + 1
    assert frames == len(made)
    assert [h["X-Page-ID"] for h, _ in warc.unpack(archive)] == [str(n) for n in range(400)]


def test_damage_is_noticed():
    archive = warc.pack([warc.record(1, None, b"payload", "00", None, False)])
    with pytest.raises(ValueError):
        list(warc.unpack(b"\0" * 8 + archive[8:]))


def test_no_pages(pages):
    assert warc.archive_and_read(pages.limit(0)).count() == 0
