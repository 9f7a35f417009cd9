"""Substring dedup by super-k-mers.

A window is K consecutive words; its minimiser is the least hash of M consecutive words in it. Consecutive windows that
share a minimiser travel as one packed string to the bucket of that minimiser, where equal windows of any text meet, and
sorting them finds the least document of each. What a bucket finds goes back to where each string stands, and a word goes
when a window over it also starts in a document of a smaller id.

Two bounded bit arrays over minimisers save work and decide nothing: those that only one document has need not travel,
and those of very many strings travel as single windows, which a task sends once however often it has them and whose
buckets are dealt out further by the window. A bit that is set in error costs work only.

Edge cases: null and empty texts have no words; a text of fewer than K words has no window; windows that repeat inside
one document, or under one id, remove nothing; a row without an id is smaller than none and has nothing removed; repeated
rows have the same result each; very long and repetitive texts travel in strings of at most LONGEST windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NOT_SPACE, Words, _hash, blocks, grams, materialise, mix, signed, small_batches
from .decontaminate import _filter

K, M = 13, 6
#: A string holds at most so many windows; a minimiser of more strings than HOT sends windows; such buckets are dealt out SPREAD ways.
LONGEST, HOT, SPREAD = 24, 10_000, 1 << 16
#: Bytes of strings whose buckets are sorted at once, and that a task holds while it joins equal ones.
AT_ONCE, HELD = 2 << 20, 32 << 20


def words(texts: list[bytes]) -> Words:
    """Words of UTF-8 texts as they are."""
    data = b" " + b" ".join(texts) + b" "
    step = np.diff(NOT_SPACE[np.frombuffer(data, np.uint8)].view(np.int8))
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data += b" " * 8
    return Words(data, start, end, np.searchsorted(start, bounds), _hash(data, start, end))


def super_kmers(h: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window's word, windows, minimiser) of each run of windows of a document that share a minimiser."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, m)
    least = g[:n].copy()
    for j in range(1, k - m + 1):
        np.minimum(least, g[j : n + j], out=least)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    least = least[at]
    new = np.concatenate([[True], (np.diff(least) != 0) | (np.diff(at) != 1)]) if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    # long runs are cut at the same places wherever they stand
    place = np.arange(len(at)) - np.repeat(head, np.diff([*head, len(at)]))
    head = np.flatnonzero(place % LONGEST == 0)
    return at[head], np.diff([*head, len(at)]), least[head]


def _minimisers(k: int, m: int):
    """(mini, low, high, n) of each minimiser of a block of texts: the least and largest document, and its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            w = words(texts)
            at, _, mini = super_kmers(w.hashes, w.first, k, m)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[np.searchsorted(w.first, at, side="right") - 1]
            order = np.argsort(mini, kind="stable")
            mini, ids = mini[order], ids[order]
            head = np.flatnonzero(np.concatenate([[True], np.diff(mini) != 0])) if len(mini) else np.zeros(0, np.int64)
            n = np.diff([*head, len(mini)])
            low, high = (f.reduceat(ids, head) if len(head) else ids for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(signed(mini[head])), pa.array(low), pa.array(high), pa.array(n)], names=["mini", "low", "high", "n"])

    return run


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h % np.uint64(8 * len(bits))
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] & (128 >> (slot & np.uint64(7)).astype(np.uint8))) != 0


def _strings(k: int, m: int, shared, hot):
    """(doc_id, text_hash, at, mini, salt, key, windows): each super-k-mer whose minimiser may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            w = words(texts)
            at, n, mini = super_kmers(w.hashes, w.first, k, m)
            here = _has(shared.value, mini)
            at, n, mini = at[here], n[here], mini[here]
            split = _has(hot.value, mini)
            # single windows in place of strings
            times = np.where(split, n, 1)
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, n, mini, split = np.repeat(at, times) + inside, np.repeat(np.where(split, 1, n), times), np.repeat(mini, times), np.repeat(split, times)
            # a digest of a string's words, beside its minimiser
            whole = grams(w.hashes, k) if len(at) else np.zeros(0, np.uint64)
            key = mix(whole[at] + mix(whole[at + n - 1] + n.astype(np.uint64))) if len(at) else whole
            salt = np.where(split, 1 + (key % np.uint64(SPREAD)).astype(np.int64), 0).astype(np.int32)
            doc = np.searchsorted(w.first, at, side="right") - 1
            packed = [b" ".join([w.data[s:e] for s, e in zip(w.start[p : p + c].tolist(), w.end[p : p + c].tolist(), strict=True)]) for p, c in zip(at.tolist(), (n + k - 1).tolist(), strict=True)]
            ids = [c.take(pa.array(doc)) for c in (batch.column(0), batch.column(2))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(at - w.first[doc]), pa.array(signed(mini)), pa.array(salt), pa.array(signed(key)), pa.array(packed, pa.binary())], names=["doc_id", "text_hash", "at", "mini", "salt", "key", "string"])

    return run, "doc_id long, text_hash long, at long, mini long, salt int, key long, string binary"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal strings of a task as one, with the least and largest document."""
    names = ["mini", "salt", "key", "string", "low", "high"]

    def out(have: dict):
        rows = [(*k, *v) for k, v in have.items()]
        for i in range(0, len(rows), 5000):
            cols = zip(*rows[i : i + 5000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=names)

    have: dict[tuple, list] = {}
    size = 0
    for batch in batches:
        for doc, *k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = tuple(k)
            v = have.get(k)
            if v is None:
                have[k] = [doc, doc]
                size += len(k[3]) + 400
            elif doc < v[0]:
                v[0] = doc
            elif doc > v[1]:
                v[1] = doc
        if size > HELD:
            yield from out(have)
            have, size = {}, 0
    yield from out(have)


def _bucket(k: int):
    """(mini, salt, key, least): for each string, for each of its windows, the least document that has it. Rows come
    sorted by bucket."""
    names = ["mini", "salt", "key", "least"]

    def sort(rows: list[tuple]) -> Iterator[tuple]:
        """Rows (mini, salt, key, string, low, high) of whole buckets."""
        windows = []
        for i, (mini, salt, key, string, low, high) in enumerate(rows):
            ends = [-1, *np.flatnonzero(np.frombuffer(string, np.uint8) == 32).tolist(), len(string)]
            windows += [(mini, salt, string[ends[j] + 1 : ends[j + k]], i, j, low, high) for j in range(len(ends) - k)]
        windows.sort(key=lambda w: w[:3])
        least: dict[int, dict] = {}
        for _, same in groupby(windows, key=lambda w: w[:3]):
            same = list(same)
            low, high = min(w[5] for w in same), max(w[6] for w in same)
            if low < high:
                for w in same:
                    least.setdefault(w[3], {})[w[4]] = low
        for i, found in least.items():
            # strings that more than one task sent have one row here
            yield (*rows[i][:3], [found.get(j) for j in range(max(found) + 1)])

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = list({r[:3]: r for r in sort(rows)}.values())
        if found:
            cols = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple] = []
        size = 0
        for row in (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if size > AT_ONCE and row[:2] != have[-1][:2]:
                yield from out(have)
                have, size = [], 0
            have.append(row)
            size += len(row[3])
        yield from out(have)

    return run, "mini long, salt int, key long, least array<long>"


def _removed(k: int):
    """(doc_id, n_words, n_removed, spans, kept) of texts with ``runs``: places of words, and bits of the windows from there."""
    names = ["doc_id", "n_words", "n_removed", "text", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            w = words(texts)
            rows = []
            for i, runs in enumerate(batch.column(2).to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                step = np.zeros(b - a + 1, np.int64)
                if runs:
                    at, bits = np.array([[r["at"], r["bits"]] for r in runs]).T
                    row, j = np.nonzero(bits[:, None] >> np.arange(LONGEST) & 1)
                    np.add.at(step, at[row] + j, 1)
                    np.add.at(step, at[row] + j + k, -1)
                gone = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0))
                spans = [{"begin": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                keep = np.flatnonzero(~gone) + a
                text = b" ".join([w.data[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                rows.append((b - a, int(gone.sum()), text, spans))
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x.decode() for x in c] if t == pa.string() else c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return run, "doc_id long, n_words long, n_removed long, text string, spans array<struct<begin:long,end:long>>"


def dedup(docs: DataFrame, *, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, text (the words kept, one space between) and spans (begin,
    end: words removed)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    named = texts.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    minis = named.select("doc_id", "text").mapInArrow(_minimisers(k, m), "mini long, low long, high long, n long")
    minis = minis.groupBy("mini").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).filter("low < high")
    minis = materialise(minis.select(F.col("mini").alias("hash"), (F.col("n") > HOT).alias("hot")), "minimisers")
    shared, hot = (spark.sparkContext.broadcast(_filter(x.select("hash"))) for x in (minis, minis.filter("hot")))
    run, schema = _strings(k, m, shared, hot)
    strings = materialise(named.mapInArrow(run, schema), "strings", "zstd")
    for sent in (shared, hot):
        sent.destroy()
    once = strings.select("doc_id", "mini", "salt", "key", "string").mapInArrow(_joined, "mini long, salt int, key long, string binary, low long, high long")
    # a bucket is a part of this shuffle; equal strings of several tasks meet there
    sorted_ = once.repartition("mini", "salt").sortWithinPartitions("mini", "salt")
    run, schema = _bucket(k)
    found = materialise(sorted_.mapInArrow(run, schema), "buckets")
    met = strings.drop("string").join(found, ["mini", "salt", "key"])
    bits = F.expr("aggregate(transform(least, (x, i) -> if(x < doc_id, shiftleft(1, i), 0)), 0, (s, x) -> s | x)")
    runs = met.select("doc_id", "text_hash", F.struct("at", bits.alias("bits")).alias("run")).filter("run.bits <> 0")
    runs = materialise(runs.groupBy("doc_id", "text_hash").agg(F.collect_set("run").alias("runs")), "runs")
    run, schema = _removed(k)
    return texts.join(runs, ["doc_id", "text_hash"], "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
