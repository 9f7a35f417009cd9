"""WARC records in seekable Zstandard bundles.

Records are put into frames that decompress on their own; a bundle is a file of frames with a seek table in a skippable
frame at its end, and the index maps each record to bundle, frame and offset in the frame. Equal payloads are stored
once: the record of the largest id is the response, the others revisit it.

Each task writes the bundles of its rows, sorted, under names that its partition decides, beside their place and then
renamed: a task that runs again leaves the same files.

Edge cases: a null payload is empty; null ids get the record id ``null`` and are responses; rows that repeat both id and
payload are all responses; line breaks in a URL are percent-encoded; an empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, small_batches

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the table's end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame int, offset int, length int"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(frame: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset of a frame, and where the next begins."""
    end = frame.index(b"\r\n\r\n", at)
    lines = frame[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[10:-1])
    url = head.get("WARC-Target-URI")
    row = {
        "page_id": number(head["WARC-Record-ID"]),
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": head["WARC-Type"],
        "payload_digest": head["WARC-Payload-Digest"][5:],
        "payload_bytes": int(head["X-Payload-Length"]),
        "refers_to": number(head.get("WARC-Refers-To")),
        "payload": frame[end + 4 : end + 4 + n],
    }
    return row, end + 4 + n + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_table(end: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from a bundle's end."""
    n, _, magic = struct.unpack("<IBI", end[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", end, len(end) - 9 - 8 * (n - i))
        out.append((at, c, d))
        at += c
    return out


class _Bundle:
    """One bundle as it is filled."""

    def __init__(self, name: str):
        self.name, self.frames, self.parts, self.index, self.open, self.rows = name, [], [], [], b"", []
        self.pending: list[bytes] = []
        self.size = self.total = 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        self.index.append((page_id, self.name, len(self.frames), self.size, len(data)))
        self.pending.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if self.pending:
            packed = self.zstd.compress(b"".join(self.pending))
            self.frames.append((len(packed), self.size))
            self.parts.append(packed)
            self.total += len(packed)
            self.pending, self.size = [], 0

    def data(self) -> bytes:
        self.flush()
        return b"".join(self.parts) + seek_table(self.frames)


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(beside) as f:
        f.write(data)
    system.move(beside, path)


def _write(to: str):
    schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(to)
        part, n, bundle = TaskContext.get().partitionId(), 0, None

        def close() -> pa.RecordBatch:
            _put(system, f"{folder}/{bundle.name}", bundle.data())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*bundle.index, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for page_id, url, payload, digest, keep, size in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                refers = keep if keep is not None and page_id is not None and keep != page_id else None
                data = record(page_id, url, (payload or "").encode() if refers is None else b"", name, refers, size)
                if bundle is not None and bundle.total + bundle.size > BUNDLE_BYTES:
                    yield close()
                    bundle = None
                if bundle is None:
                    bundle, n = _Bundle(f"{part:08d}-{n:05d}.warc.zst"), n + 1
                bundle.add(page_id, data)
        if bundle is not None:
            yield close()

    return run


def write(pages: DataFrame, to: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write a record for each row into bundles under ``to`` (a URI) and return the index. Payloads of fewer than
    ``least`` bytes are all stored."""
    small_batches(pages.sparkSession)
    system, folder = fs.FileSystem.from_uri(to)
    system.create_dir(folder, recursive=True)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    many = rows.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1").select("digest", "keep")
    joined = rows.join(materialise(many, "payloads"), "digest", "left").select("page_id", "url", "payload", "digest", "keep", "size")
    return materialise(joined.sortWithinPartitions("page_id", "digest", "url").mapInArrow(_write(to), INDEX), "index")


def _records(data: bytes) -> Iterator[dict]:
    unzip = zstandard.ZstdDecompressor()
    for at, packed, size in read_table(data):
        frame = unzip.decompress(data[at : at + packed], max_output_size=size)
        place = 0
        while place < len(frame):
            row, place = parse(frame, place)
            if row["record_type"] == "response" and base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode() != row["payload_digest"]:
                raise ValueError(f"payload of {row['page_id']} is damaged")
            yield row


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """All records of the bundles under ``path``, each payload checked against its digest."""
    names = [x.strip().split(" ")[0] for x in RECORD.split(",")][: 7 if payloads else 6]
    schema = ", ".join(RECORD.split(", ")[: len(names)])
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                size = 0
                for row in _records(data.as_py()):
                    rows.append(row)
                    size += len(row["payload"]) if payloads else 100
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=False)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=False)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(run, schema)


def fetch(index: DataFrame, to: str) -> DataFrame:
    """The records that rows of the index name, reading only the seek tables and the frames they are in."""
    names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(to)
        for batch in batches:
            rows = []
            for bundle, frame, offset in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                size = system.get_file_info(f"{folder}/{bundle}").size
                with system.open_input_file(f"{folder}/{bundle}") as f:
                    n = struct.unpack("<IBI", f.read_at(9, size - 9))[0]
                    at, packed, whole = read_table(f.read_at(9 + 8 * n, size - 9 - 8 * n))[frame]
                    data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at), max_output_size=whole)
                rows.append(parse(data, offset)[0])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)

    return index.select("bundle", "frame", "offset").mapInArrow(run, RECORD)
