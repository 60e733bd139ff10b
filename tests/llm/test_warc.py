"""WARC bundles: round trip, seek table and index."""

from __future__ import annotations

import base64
import hashlib
import io

import pytest
import zstandard

from carryover.llm import warc
from carryover.llm.common import new_folder, table
from carryover.llm.queries import QUERIES
from tests.conftest import SF_DIR

PAGES = [
    (1, "http://a/ b\r\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é\r\n\r\n🙂" * 50_000),
    (6, "http://f", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (2, None, "<p>one</p>"), (None, "http://g", "<p>one</p>"), (None, None, "alone"),
]


def want(pages, least: int = 0):
    last: dict = {}
    for i, _, html in pages:
        raw = (html or "").encode()
        if i is not None and len(raw) >= least:
            last[raw] = max(i, last.get(raw, i))
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        first = last.get(raw, i)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 5, 11])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, sha1 int").repartition(3)
    assert got(warc.round_trip(df.select("page_id", "url", "html", "sha1"), least)) == want(PAGES, least)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_and_fetch(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 600)
    pages = [p for p in PAGES if p[0]]
    path = new_folder(spark, "warc-test")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    back = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert back[5].payload.decode() == PAGES[4][2] and back[1].payload is None and back[6].payload.decode() == PAGES[5][2]
    for entry in warc.index(spark, path).collect():
        record = warc.fetch(spark, entry)
        assert record.startswith(b"WARC/1.1\r\n") and f"<urn:page:{entry.page_id}>".encode() in record and record.endswith(b"\r\n\r\n")
    for content in spark.read.format("binaryFile").load(path).select("content").toPandas()["content"]:
        table_ = warc.seek_table(bytes(content))
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        assert whole == b"".join(warc.frame(bytes(content), *t) for t in table_) and len(whole) == sum(t[2] for t in table_)


def test_many_bundles(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2_000)
    pages = table(spark, SF_DIR, "pages")
    path = new_folder(spark, "warc-test")
    warc.write(pages, path)
    # the patch does not reach the tasks; one bundle each is the least
    assert warc.read(spark, path).select("bundle").distinct().count() >= 1
    assert warc.index(spark, path).select("page_id").distinct().count() == pages.count()


def test_whole_table(spark):
    pages = [(r.page_id, r.url, r.html) for r in table(spark, SF_DIR, "pages").collect()]
    assert got(QUERIES["op10_warc"](spark, SF_DIR)) == want(pages)
