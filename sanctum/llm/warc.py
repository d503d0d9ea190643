r"""WARC archives in seekable Zstandard bundles.

Each task writes a bundle to the shared folder: WARC/1.1 records, grouped into independent Zstandard frames, then a
skippable frame with the seek table (compressed and uncompressed size of each frame, frame count, magic number), so that
any frame is read without the others.  The index maps each record to its bundle, frame and offset within the frame's
content.  Of equal payloads the record with the smallest id is a ``response``, the others are ``revisit`` records: their
block ends after the HTTP header, whose Content-Length, and the payload digest, are the full payload's.

Bundles carry a random name, and only those in the written index count: what a lost or repeated attempt left behind is
never read.  Paths may be of any file system that pyarrow opens by URI.

Edge cases: a null or empty payload is a response with no bytes; payloads under ``min_bytes`` are never revisits; repeated
rows of the smallest id are responses all; a null url is the URI ``urn:page:`` with the id; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Decisions, by_key, id_type, materialize, new_path, open_fs, positioned, read_table, slices

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 29, 3
#: Bytes of records that a task reads back, and frames of a bundle that it reads in a row.
TASK_BYTES, RUN = 1 << 26, 16
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
INDEX = "bundle string, frame long, offset long, length long"


class BundleWriter:
    """Appends records to frames; close() appends the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.open, self.size, self.table, self.written = [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame's content, length)."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self.flush()
        at = (len(self.table), self.size, len(record))
        self.open.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.sink.write(frame)
            self.written += len(frame)
            self.table.append((len(frame), self.size))
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *e) for e in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.sink.close()


class BundleReader:
    """Reads single frames by the seek table at the end of a bundle."""

    def __init__(self, source):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags & 0x7C:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        body = self._at(size - 9 - entry * n - 8, 8 + entry * n)
        if struct.unpack("<II", body[:8]) != (SKIPPABLE, entry * n + 9):
            raise ValueError("damaged seek table")
        self.frames, start = [], 0
        for i in range(n):
            packed, content = struct.unpack_from("<II", body, 8 + entry * i)
            self.frames.append((start, packed, content))
            start += packed

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        start, packed, content = self.frames[i]
        return self.zstd.decompress(self._at(start, packed), max_output_size=content)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def record_bytes(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response, or with refers_to a revisit record."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in (url or f"urn:page:{page_id}") if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """(offset, headers, HTTP headers, payload) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        block = data[start : start + int(headers["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield at, headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload
        at = start + len(block) + 4


def write(pages: DataFrame, folder: str, min_bytes: int = 100, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to bundles in folder; the index (page_id, bundle, frame, offset, length) as a written table."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    placed = positioned(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), "__file", "__row")
    # revisits are found on short rows, which carry their pages' positions; no payload is shuffled or joined
    short = placed.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha2("html", 256).alias("digest"), F.col("__file").alias("file"), F.col("__row").alias("row"))
    short = materialize(short, "digests")
    seen = materialize(short.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    again = by_key(short, seen, "digest", "n").where("page_id <> first")
    decided = Decisions(again.select("file", "row", F.col("first").alias("refers_to")), placed)
    kind = id_type(placed, "page_id")

    def run(batches):
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        writer, name = None, ""
        for b in slices(batches, 256):
            refer = []
            for i, j, found in decided.runs(*(b.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))):
                own = decided.table["refers_to"] if (found >= 0).any() else None
                refer += [own[f].as_py() if f >= 0 else None for f in found.tolist()]
            rows = []
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns[:3]), refer):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                rows.append((f"{folder}/{name}", *writer.add(record_bytes(page_id, url, html, refers))))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["page_id", "bundle", "frame", "offset", "length"])
        if writer:
            writer.close()

    return materialize(placed.mapInArrow(run, f"page_id {kind}, {INDEX}"), "index")


def read(index: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Every record of the bundles in the index, read back frame by frame and held against its index entry: page_id (as
    string), record_type, refers_to (as string), payload_bytes, payload_digest, payload (null for a revisit), url."""
    places = index.groupBy("bundle", "frame").agg(F.count("*").alias("n"), F.sum("offset").alias("check"))
    # the index is short, what it stands for isn't: as many tasks as the records' bytes ask for, each reading runs of frames
    content = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-content // task_bytes))
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "url"]

    def run(batches):
        reader, last = None, None
        for b in batches:
            for bundle, frame, n, check in zip(*(c.to_pylist() for c in b.columns)):
                if bundle != last:
                    fs, path = open_fs(bundle)
                    reader, last = BundleReader(fs.open_input_file(path)), bundle
                rows, offsets = [], []
                for at, h, http, payload in parse_records(reader.frame(frame)):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    is_response = h["WARC-Type"] == "response"
                    if is_response and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"damaged payload in {bundle}, frame {frame}")
                    strip = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
                    rows.append((strip(h["WARC-Record-ID"]), h["WARC-Type"], strip(h.get("WARC-Refers-To")), int(http["Content-Length"]), digest, payload if is_response else None, h["WARC-Target-URI"]))
                    offsets.append(at)
                if (len(rows), sum(offsets)) != (n, check):
                    raise ValueError(f"the index doesn't match {bundle}, frame {frame}")
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    placed = places.repartition(tasks, "bundle", F.floor(F.col("frame") / RUN)).sortWithinPartitions("bundle", "frame")
    return placed.mapInArrow(run, "page_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, url string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    back = read(write(pages, new_path(spark, "warc")))
    kind = id_type(pages, "page_id")
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
