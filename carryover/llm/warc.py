"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is a file of
such frames and ends in the seek table of the Zstandard seekable format (a skippable
frame that lists the compressed and full size of every frame).  An index maps each
record to its bundle, frame and offset in the frame, so one record is read by
decompressing one frame.

Bundles are written by Spark's own text sink, one row to a file, so that they reach
any store Spark writes to under its commit protocol: the bytes of a bundle end in the
seekable format's magic number, whose last three bytes are the UTF-8 form of the
letter U+A48F, and that letter is the sink's line separator.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.llm.common import new_folder

#: Record bytes gathered into one frame, and compressed bytes after which a bundle is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 4 << 20
#: The skippable frame of a seek table, and the last number of the file.
SEEK_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
LAST_LETTER = struct.pack("<I", SEEK_MAGIC)[1:].decode()
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


def base32_sha1(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; absent values have no header, control characters of a URL are escaped."""
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": None if page_id is None else f"<{ID}{page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{ID}{refers_to}>"}
        body = http + b"\r\n"
    else:
        body = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head["Content-Length"] = str(len(body))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


class Bundle:
    """Frames in the making; ``close`` returns the whole file but the last letter."""

    def __init__(self, level: int = 3):
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.waiting = self.bytes = 0

    def add(self, record: bytes) -> None:
        if self.waiting and self.waiting + len(record) > FRAME_BYTES:
            self._frame()
        self.open.append(record)
        self.waiting += len(record)

    def _frame(self) -> None:
        if self.open:
            packed = self.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.waiting))
            self.bytes += len(packed)
            self.open, self.waiting = [], 0

    def full(self) -> bool:
        return self.bytes >= BUNDLE_BYTES

    def close(self) -> bytes | None:
        self._frame()
        if not self.frames:
            return None
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        foot = struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        out = b"".join(self.frames) + struct.pack("<II", SEEK_FRAME, len(table) + len(foot)) + table + foot
        return out[: -len(LAST_LETTER.encode())]


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, full size) of each frame, read from the end of the file."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("not a seekable bundle")
    sizes = list(struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]))
    out, at = [], 0
    for packed, full in sizes:
        out.append((at, packed, full))
        at += packed
    return out


def frame(bundle: bytes, at: int, packed: int, full: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=full)


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of a frame."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")[1:]
        head = dict(line.split(": ", 1) for line in lines)
        body = head_end + 4
        end = body + int(head["Content-Length"])
        payload = data[data.index(b"\r\n\r\n", body) + 4 : end]
        yield at, end + 4 - at, head, payload
        at = end + 4


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``sha1``, ``revisit`` and ``refers_to``.

    Of the pages whose equal payload has at least ``least_bytes`` the one with the
    largest id is the response and the others revisit it.  Ids and digests are
    counted per digest before anything is joined; only digests of several pages are
    joined back, so a digest that a third of the pages share is one row on that side
    and its pages are an ordinary skewed join side.  Rows without an id are below all ids;
    where no equal page has one, or the largest id is repeated, each is a response.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("sha1"))
    sized = known.where(F.octet_length("html") >= least_bytes)
    shared = sized.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last IS NOT NULL")
    joined = known.join(shared.select("sha1", "last"), "sha1", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` into bundles under ``path``, which must not exist.

    A null or empty html is an empty payload; a record is never split, so one larger
    than a frame is a frame of its own.  A task holds one bundle at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle()
        for batch in batches:
            for page_id, url, html, sha1, revisit, refers_to in zip(*[c for c in batch.columns]):
                bundle.add(_record(page_id.as_py(), url.as_py(), html.as_py(), base32_sha1(sha1.as_py()), refers_to.as_py(), revisit.as_py(), date))
                if bundle.full():
                    yield _row(bundle.close())
                    bundle = Bundle()
        if (last := bundle.close()) is not None:
            yield _row(last)

    rows = roles(pages, least_bytes).withColumn("html", F.col("html").cast("binary"))
    bundles = rows.mapInArrow(run, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    bundles.write.option("lineSep", LAST_LETTER).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _row(bundle: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bundle], pa.binary())], names=["bundle"])


def read(spark: SparkSession, path: str, id_type: str = "long", content: bool = True) -> DataFrame:
    """Every record of the bundles under ``path``, with its place.

    Columns: page_id, url, record_type, refers_to, payload_digest, payload_bytes,
    payload (null for a revisit, and left out with ``content=False``), bundle, frame,
    frame_at, frame_packed, frame_full, record_at, record_bytes.  The digest of a
    response is computed anew from its payload and must equal the one it states.
    """
    number = int if id_type in ("long", "bigint", "int") else str

    def of(urn: str | None):
        return None if urn is None else number(urn[1 + len(ID) : -1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                data = data.as_py()
                if not data:  # the file of a task without rows
                    continue
                for k, (at, packed, full) in enumerate(seek_table(data)):
                    rows = []
                    for offset, length, head, payload in records(frame(data, at, packed, full)):
                        kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(head["X-Payload-Length"])
                        if kind == "response" and (base32_sha1(hashlib.sha1(payload).hexdigest()) != stated or len(payload) != size):
                            raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
                        rows.append((
                            of(head.get("WARC-Record-ID")), head.get("WARC-Target-URI"), kind, of(head.get("WARC-Refers-To")), stated, size,
                            payload if content and kind == "response" else None, name.as_py(), k, at, packed, full, offset, length,
                        ))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = (
        f"page_id {id_type}, url string, record_type string, refers_to {id_type}, payload_digest string, payload_bytes long, "
        "payload binary, bundle string, frame int, frame_at long, frame_packed long, frame_full long, record_at long, record_bytes long"
    )
    own = pa.int64() if number is int else pa.string()
    kinds = [own, pa.string(), pa.string(), own, pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int32(), *[pa.int64()] * 5]
    names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, schema)
    return found if content else found.drop("payload")


def index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, bundle, frame, frame_at, frame_packed, frame_full, record_at, record_bytes) of every record."""
    return read(spark, path, id_type, content=False).select(
        "page_id", "bundle", "frame", "frame_at", "frame_packed", "frame_full", "record_at", "record_bytes"
    )


def fetch(spark: SparkSession, entry) -> bytes:
    """The bytes of one record, given its index row: one ranged read, one frame."""
    name = spark._jvm.org.apache.hadoop.fs.Path(entry["bundle"])
    stream = name.getFileSystem(spark._jsc.hadoopConfiguration()).open(name)
    try:
        stream.seek(entry["frame_at"])
        packed = bytes(stream.readNBytes(entry["frame_packed"]))
    finally:
        stream.close()
    data = frame(packed, 0, entry["frame_packed"], entry["frame_full"])
    return data[entry["record_at"] : entry["record_at"] + entry["record_bytes"]]


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to a new folder of the shared one, and read the records back without payloads."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write(pages, path, least_bytes)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read(spark, path, kind, content=False)
