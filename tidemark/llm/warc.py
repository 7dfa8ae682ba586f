"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent frames, each of whole records, closed by a seek table in the
seekable format (a skippable frame, so plain readers pass over it). An index maps each record to its
bundle, frame and offset within the frame; one record costs the decompression of one frame.

Bundles are written by the tasks to a shared folder through pyarrow's file systems (file, hdfs, s3):
first under a name of the attempt, then moved to one that follows from the partition alone, so a
task that runs again replaces its own files.

Edge cases: null html is an empty payload; a null url gives a record without target; equal payloads
of at least ``least_bytes`` are stored once, smaller ones each; rows that repeat a page_id with an
equal payload are all responses if that is the smallest; an empty table gives no bundle; a record
larger than a frame has one of its own; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
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

from tidemark.llm.common import slices

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit of the page ``refers_to``, which has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(" " if c in "\r\n" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at ``at``."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    end = head_end + 4 + int(headers["Content-Length"])
    return headers, data[head_end + 4 : end], end + 4


def row_of(headers: dict[str, str], block: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes]:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of a record."""
    number = lambda name: None if (x := headers[name][len(RECORD) + 1 : -1]) == "None" else int(x)
    http, payload = block.split(b"\r\n\r\n", 1)
    revisit = headers["WARC-Type"] == "revisit"
    size = int(http.rpartition(b"Content-Length: ")[2])
    stated = headers["WARC-Payload-Digest"].partition(":")[2]
    if not revisit and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    return number("WARC-Record-ID"), headers.get("WARC-Target-URI"), size, stated, headers["WARC-Type"], number("WARC-Refers-To") if revisit else None, payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames_of(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame, from the seek table."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    sizes = list(struct.iter_unpack("<II", file.read(8 * count)))
    out, at = [], 0
    for compressed, plain in sizes:
        out.append((at, compressed, plain))
        at += compressed
    return out


def read_record(folder: str, bundle: str, frame: int, offset: int) -> tuple:
    """One record by its place in the index; only its frame is read."""
    files, base = fs.FileSystem.from_uri(folder)
    with files.open_input_file(posixpath.join(base, bundle)) as file:
        start, compressed, plain = frames_of(file)[frame]
        file.seek(start)
        data = zstandard.ZstdDecompressor().decompress(file.read(compressed), max_output_size=plain)
    headers, block, _ = parse(data, offset)
    return row_of(headers, block)


class Bundles:
    """Writes records to bundles of one partition; ``index`` gets (page_id, bundle, frame, offset, length)."""

    def __init__(self, folder: str, partition: int, frame_bytes: int, bundle_bytes: int) -> None:
        self.files, self.base = fs.FileSystem.from_uri(folder)
        self.partition, self.frame_bytes, self.bundle_bytes = partition, frame_bytes, bundle_bytes
        self.number, self.out = 0, None
        self.zstd = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.index: list[tuple] = []
        self.held, self.size, self.frames, self.written = [], 0, [], 0

    def name(self) -> str:
        return f"part-{self.partition:06d}-{self.number:05d}.warc.zst"

    def add(self, page_id: int, data: bytes) -> None:
        if self.held and self.size + len(data) > self.frame_bytes:
            self.end_frame()
        self.index.append((page_id, self.name(), len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def end_frame(self) -> None:
        if self.out is None:
            self.attempt = posixpath.join(self.base, f".{self.name()}-{uuid.uuid4().hex}")
            self.out = self.files.open_output_stream(self.attempt)
        packed = self.zstd.compress(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0
        if self.written >= self.bundle_bytes:
            self.end_bundle()

    def end_bundle(self) -> None:
        if self.held:
            return self.end_frame() or self.end_bundle()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.files.move(self.attempt, posixpath.join(self.base, self.name()))
            self.number, self.out, self.frames, self.written = self.number + 1, None, [], 0


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to: the smallest page_id of equal payloads, null for itself."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    all_pages = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    key = F.when(F.length("payload") >= least_bytes, F.sha2("payload", 256))
    first = all_pages.select("page_id", key.alias("same")).filter("same is not null").groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first")
    joined = all_pages.withColumn("same", key).join(first, "same", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, *, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the bundles of all pages under ``folder`` and their index to its table ``index``, which is returned."""
    schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
    spark = pages.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/bundles")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles = Bundles(f"{folder}/bundles", TaskContext.get().partitionId(), frame_bytes, bundle_bytes)
        for batch in batches:
            for part in slices(batch):
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    bundles.add(page_id, record(page_id, url, payload, refers_to))
        bundles.end_bundle()
        for at in range(0, len(bundles.index), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*bundles.index[at : at + 10_000], strict=True), schema, strict=True)], schema=schema)

    ordered = with_originals(pages, least_bytes).sortWithinPartitions("page_id", "refers_to", "url", "payload")
    ordered.mapInArrow(run, "page_id long, bundle string, frame long, offset long, length long").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the bundles in ``folder``, a frame at a time; payload is null for revisits."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(f"{folder}/bundles")
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(posixpath.join(base, name)) as file:
                    for start, compressed, plain in frames_of(file):
                        file.seek(start)
                        data, at, rows = zstd.decompress(file.read(compressed), max_output_size=plain), 0, []
                        while at < len(data):
                            headers, block, at = parse(data, at)
                            row = row_of(headers, block)
                            rows.append(row if row[5] is None else (*row[:6], None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    names = spark.read.parquet(f"{folder}/index").select("bundle").distinct()
    names = names.repartition(spark.sparkContext.defaultParallelism * 4, "bundle")
    return names.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def sql() -> str:
    """What reading the archives of ``pages`` back gives, as SQL for DuckDB; page ids must be unique."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {letter}), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"""
