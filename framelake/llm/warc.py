"""WARC records in seekable Zstandard bundles.

``write_bundles`` turns rows into WARC records, groups them into independent
Zstandard frames of about ``frame_bytes``, appends the public seekable format's
footer (a skippable frame with each frame's compressed and plain size) and
returns an index that maps each record to its bundle, frame and the offset
within the plain frame. ``read_bundles`` reads whole bundles frame by frame;
``read_records`` seeks to single records by the index.

Payloads that occur more than once are stored once: of the records with equal
payloads of at least ``revisit_bytes`` bytes the one with the largest id is a
``response`` with the payload, the others are ``revisit`` records that refer to
it by its record id; smaller payloads are always stored in full.

At scale: the SHA-1 digests are made in the JVM and summed to one row per
repeated payload before the join, so that a payload of a third of all pages is
one row. That table is written first, and Spark broadcasts it only if its file
size is under the session's broadcast limit; beyond, the join shuffles and AQE
splits a digest that is skewed. Revisits leave their payload behind before the
rows reach Python. Each task writes its own bundles and holds one frame at a
time. Names carry the attempt's random id, and only the rows of the committed
attempt reach the index, so a retried or speculative task does no harm beyond a
file that no index row names.

Edge cases: a null payload is empty; a null id is smaller than any other and
reads back as null; if all ids of a payload are null, or rows repeat the largest
id, each of those rows is a response (none is lost); a null URI is written as
``about:blank``, and control characters and blanks in URIs are percent-encoded;
an empty table gives an empty index; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, filesystem, new_path, stored

REVISIT_BYTES = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
WARC_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the public Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX_SCHEMA = "record_id bigint, bundle string, frame int, frame_offset bigint, frame_size bigint, offset_in_frame bigint, record_size bigint"
RECORD_SCHEMA = "record_id bigint, target_uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def _name(record_id) -> str:
    return f"<urn:record:{'' if record_id is None else record_id}>"


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:record:").removesuffix(">")
    return int(digits) if digits else None


def _uri(url: str | None) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "about:blank"


def record(record_id, url, payload: bytes | None, digest: str, size: int, refers_to=None, date=WARC_DATE) -> bytes:
    """One WARC/1.1 record: a response with the payload, or without one a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_name(record_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return headers, data[end + 4 : end + 4 + size], end + 8 + size


def described(headers: dict[str, str], block: bytes) -> tuple:
    """What a record says, in the order of RECORD_SCHEMA; a response's digest and size are taken from its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["WARC-Type"]
    if kind == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        if f"sha1:{digest}" != headers["WARC-Payload-Digest"]:
            raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not match its digest")
    else:
        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(head.rpartition(b"Content-Length: ")[2])
    refers = _number(headers.get("WARC-Refers-To"))
    return _number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], kind, size, digest, refers


class BundleWriter:
    """Writes records into one bundle; ``close`` returns the rows of its index."""

    def __init__(self, files, folder: str, uri: str, frame_bytes: int, level: int):
        import zstandard

        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.out = f"{uri}/{name}", files.open_output_stream(f"{folder}/{name}", compression=None)
        self.packer, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_checksum=True), frame_bytes
        self.frames, self.offset, self.rows, self.plain, self.held, self.held_bytes = [], 0, [], [], [], 0

    def add(self, record_id, data: bytes) -> None:
        self.held.append((record_id, self.held_bytes, len(data)))
        self.plain.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        packed = self.packer.compress(b"".join(self.plain))
        self.out.write(packed)
        k = len(self.frames)
        self.rows += [(i, self.path, k, self.offset, len(packed), at, size) for i, at, size in self.held]
        self.frames.append((len(packed), self.held_bytes))
        self.offset += len(packed)
        self.held, self.plain, self.held_bytes = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return self.rows


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the footer."""
    end = f.size()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC or flags & 0x80:
        raise ValueError("no seek table without checksums at the end of the file")
    f.seek(end - 9 - 8 * n)
    sizes, at, out = struct.iter_unpack("<II", f.read(8 * n)), 0, []
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


INDEX_ARROW = pa.schema([("record_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), *((n, pa.int64()) for n in ("frame_offset", "frame_size", "offset_in_frame", "record_size"))])
RECORD_ARROW = pa.schema([("record_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def write_bundles(df: DataFrame, record_id="page_id", url="url", payload="html", path: str | None = None, revisit_bytes=REVISIT_BYTES, frame_bytes=FRAME_BYTES, bundle_bytes=BUNDLE_BYTES, level=3) -> DataFrame:
    """Writes the rows as bundles under ``path`` (default: in the shared folder) and returns their stored index."""
    spark = df.sparkSession
    uri = (path or new_path(spark, "bundles")).rstrip("/")
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(record_id).cast("long").alias("id"), F.col(url).alias("url"), text.alias("payload"), F.sha1(text).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    again = rows.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    again = stored(again.select("digest", "first"), "repeated-payloads")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.join(again, "digest", "left").select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(uri)
        writer, size = None, 0
        for batch in cut(batches, "payload"):
            for i, link, body, digest, n, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    files.create_dir(folder, recursive=True)
                    writer, size = BundleWriter(files, folder, uri, frame_bytes, level), 0
                data = record(i, link, None if body is None else body.encode(), digest, n, refers)
                writer.add(i, data)
                size += len(data)
                if size >= bundle_bytes:
                    yield _batches(writer.close(), INDEX_ARROW)
                    writer = None
        if writer is not None:
            yield _batches(writer.close(), INDEX_ARROW)

    return stored(rows.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_bundles(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the index's bundles, read frame by frame in RECORD_SCHEMA; payload digests are verified."""
    bundles = index.select("bundle").distinct()
    n = index.agg(F.count_distinct("bundle")).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                files, where = filesystem(bundle)
                with files.open_input_file(where) as f:
                    rows = []
                    for at, packed, plain in seek_table(f):
                        f.seek(at)
                        data, at = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain), 0
                        while at < len(data):
                            headers, block, at = parse(data, at)
                            rows.append(described(headers, block))
                        if len(rows) >= 5000:
                            yield _batches(rows, RECORD_ARROW)
                            rows = []
                    if rows:
                        yield _batches(rows, RECORD_ARROW)

    return bundles.repartition(max(1, n)).mapInArrow(read, RECORD_SCHEMA)


def read_records(index: DataFrame) -> DataFrame:
    """The records that the rows of ``index`` name (filter it first), each read by a seek to its frame: record_id and the whole record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            ids, out = [], []
            for row in batch.to_pylist():
                files, where = filesystem(row["bundle"])
                with files.open_input_file(where) as f:
                    f.seek(row["frame_offset"])
                    packed = io.BytesIO(f.read(row["frame_size"]))
                data = zstandard.ZstdDecompressor().stream_reader(packed).read()
                ids.append(row["record_id"])
                out.append(data[row["offset_in_frame"] : row["offset_in_frame"] + row["record_size"]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["record_id", "record"])

    return index.mapInArrow(read, "record_id bigint, record binary")


def op8_warc(spark, sf_dir):
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_bundles(spark, index).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g
"""
