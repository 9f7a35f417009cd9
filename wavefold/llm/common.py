"""Scratch tables in the shared folder, and word hashing for Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset; it gets
    a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wavefold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table or a folder of files in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table: lost executors recompute nothing
    before it, and a join that reads it gets plain exchanges, which adaptive execution can split where a key is hot."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """From now on the session gives Python at most so many rows at once: rows that hold whole texts or token sets are
    large, and a batch is held on both sides of the pipe. What returns lazily runs later, so this stays set."""
    if not 0 < int(spark.conf.get(ROWS_KEY)) <= rows:
        spark.conf.set(ROWS_KEY, str(rows))


_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def byte_class(pattern: bytes) -> np.ndarray:
    """For each byte value whether it is in ``pattern``."""
    table = np.zeros(256, np.uint8)
    table[list(pattern)] = 1
    return table


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Everything but ASCII white space; bytes of non-ASCII characters are all word bytes.
NOT_SPACE = 1 - byte_class(b" \t\n\v\f\r")
#: Digits, a-z (after lower-casing) and everything outside ASCII.
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


@dataclass
class Words:
    """The words of some documents: ``first`` has, for each document, where its words begin, and the end of all."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def _hash(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    left = end - start
    h = mix(left.astype(np.uint64) * _STEP)
    at, who = start.copy(), None
    while True:
        part = eight[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        if who is None:
            h = mix((h ^ part) * _STEP)
            who = np.flatnonzero(left > 8)
        else:
            h[who] = mix((h[who] ^ part) * _STEP)
            who = who[left > 8]
        if not len(who):
            return h
        keep = left > 8
        at, left = at[keep] + 8, left[keep] - 8


def words(texts: list[bytes], word_bytes: np.ndarray) -> Words:
    """Words of UTF-8 texts, A-Z lower-cased; ``word_bytes`` marks the bytes that words are made of."""
    data = (b" " + b" ".join(texts) + b" ").translate(LOWER)
    flag = word_bytes[np.frombuffer(data, np.uint8)].view(np.int8)
    step = np.diff(flag)
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data += b" " * 8
    return Words(data, start, end, np.searchsorted(start, bounds), _hash(data, start, end))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive entries of ``h``; windows over document bounds are the caller's to drop."""
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * _STEP + h[j : len(h) - k + 1 + j]
    return mix(out)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of at most ``most`` bytes of text (or one longer document), each with its texts in UTF-8; null is empty."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at).cast(pa.binary())), 0).to_pylist()
        begin, size = 0, 0
        for i, n in enumerate([*lengths, most]):
            if i == len(lengths) or size and size + n > most:
                if begin < i:
                    part = batch.slice(begin, i - begin)
                    yield part, [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                begin, size = i, 0
            size += n


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
