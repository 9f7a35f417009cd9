"""Benchmark decontamination by winnowing.

Both sides are cut into words. Of the k-grams of each window of ``window`` words the least hash is its fingerprint, so
that a span of ``window`` words that both sides share has the same one on either. The benchmark's fingerprints are joined
with the texts' in two steps: a filter of the benchmark's, of bounded size, leaves the texts' windows with a fingerprint
that may be there, and those meet the benchmark's windows in a Spark join on fingerprint and words, which settles each
hit exactly. Equal windows of a text, or of the benchmark, are one row with all its places, in runs, so that repetitive
passages on both sides cost no more than others. Hits are extended over adjacent windows to spans.

Edge cases: null and empty texts have no words and no hits; a null item text gives no window; items of fewer than
``window`` words count as one window of their own length; an item without an id hits like any other and is left out of
``items``; each input row gives one row, repeated rows and ids included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import ALNUM, blocks, grams, materialise, signed, small_batches, words

K = 5
#: The filter has so many bits at least, and at most, of which one piece at a time is made.
FILTER_BITS, MOST_BITS, PIECE_BITS = 1 << 22, 1 << 28, 1 << 15
#: Bits for each distinct fingerprint of the benchmark, where there is room.
SPARE = 16


def fingerprints(h: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place where a window of ``window`` words begins, its least hash of k words, and the places."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = grams(h, k)
    least = g[: n - window + 1].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, g[j : n - window + 1 + j], out=least)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    return least[at], at


def _kinds(window: int, lengths: list[int]) -> list[tuple[int, int]]:
    """(words of a window, words of its k-grams) for windows of the usual and of shorter length."""
    return [(n, min(K, n) if n == window else n) for n in [window, *lengths]]


def _runs(at: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Spans of n words from sorted places, adjacent and overlapping ones as one."""
    cut = np.flatnonzero(np.diff(at) > n) + 1
    begin, end = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + n
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def _windows(data: bytes, start: np.ndarray, end: np.ndarray, at: list[int], n: int) -> list[bytes]:
    """The words of each window, in lower case, with a space between."""
    return [b" ".join(data[s:e] for s, e in zip(start[p : p + n].tolist(), end[p : p + n].tolist(), strict=True)) for p in at]


def _items(window: int):
    """(hash, kind, words, item) of the distinct windows of each item; kind is the window's length in words."""
    schema = pa.schema([("hash", pa.int64()), ("kind", pa.int32()), ("words", pa.binary()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            w = words(texts, ALNUM)
            for i, item in enumerate(batch.column(0).to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if a == b:
                    continue
                [(kind, k)] = _kinds(window, [min(window, b - a)])[-1:]
                g, at = fingerprints(w.hashes[a:b], np.array([0, b - a]), k, kind)
                rows = dict(zip(_windows(w.data, w.start[a:b], w.end[a:b], at.tolist(), kind), signed(g).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(rows.values()), pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array(list(rows), pa.binary()), pa.array([item] * len(rows), pa.string())], schema=schema)

    return run, "hash long, kind int, words binary, item string"


def _filter(hashes: DataFrame) -> np.ndarray:
    """Packed bits, of a number that suits the distinct ``hashes`` (hash) and is a power of two up to MOST_BITS; bit
    hash mod their number is set for each hash."""
    bits = FILTER_BITS
    wanted = SPARE * hashes.distinct().count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1).cast("long"))

    def pack(key, pdf):
        mask = np.zeros(PIECE_BITS, np.uint8)
        mask[pdf["low"].to_numpy()] = 1
        return pdf.iloc[:1][["piece"]].assign(bits=[np.packbits(mask).tobytes()])

    slots = hashes.select(F.floor(slot / PIECE_BITS).cast("int").alias("piece"), (slot % PIECE_BITS).cast("int").alias("low")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for piece, packed in slots.groupBy("piece").applyInPandas(pack, "piece int, bits binary").toLocalIterator():
        out[piece * (PIECE_BITS // 8) : (piece + 1) * (PIECE_BITS // 8)] = np.frombuffer(packed, np.uint8)
    return out


_TEXTS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("text_hash", pa.int64()), ("own", pa.int32()), ("hash", pa.int64()), ("kind", pa.int32()), ("words", pa.binary()), ("runs", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])


def _texts(window: int, short: list[int], sent):
    """A row for each document (own: how many windows it has below), and one for each distinct window of it whose
    fingerprint passes the filter, with the spans of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        rid = TaskContext.get().partitionId() << 40
        for batch, texts in blocks(batches, "text"):
            n = len(texts)
            w = words(texts, ALNUM)
            own = np.zeros(n, np.int32)
            rows: list[tuple] = []
            for kind, k in _kinds(window, short):
                g, at = fingerprints(w.hashes, w.first, k, kind)
                slot = g % np.uint64(8 * len(bits))
                hit = np.flatnonzero(bits[(slot >> np.uint64(3)).astype(np.int64)] & (128 >> (slot & np.uint64(7)).astype(np.uint8)))
                if not len(hit):
                    continue
                at, g = at[hit], g[hit]
                doc = np.searchsorted(w.first, at, side="right") - 1
                # equal windows of a document together, by their words' hashes, in order of place
                whole = grams(w.hashes, kind)[at]
                order = np.lexsort((at, whole, doc))
                head = np.flatnonzero(np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(whole[order]) != 0)]))
                own += np.bincount(doc[order[head]], minlength=n).astype(np.int32)
                first = order[head]
                texts_ = _windows(w.data, w.start, w.end, at[first].tolist(), kind)
                for i, j, d, h, x in zip(head.tolist(), [*head[1:].tolist(), len(order)], doc[first].tolist(), signed(g[first]).tolist(), texts_, strict=True):
                    rows.append((rid + d, h, kind, x, [{"begin": a, "end": b} for a, b in _runs(at[order[i:j]] - int(w.first[d]), kind)]))
            no = lambda t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + n)), pa.array(batch.column(0).to_pylist(), pa.int64()), pa.array(np.diff(w.first).astype(np.int64)), batch.column(2), pa.array(own), *(no(t) for t in _TEXTS.types[5:])], schema=_TEXTS)
            for i in range(0, len(rows), 5000):
                ids, *rest = zip(*rows[i : i + 5000], strict=True)
                m = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.nulls(m, t) for t in _TEXTS.types[1:5]), *(pa.array(c, t) for c, t in zip(rest, _TEXTS.types[5:], strict=True))], schema=_TEXTS)
            rid += n

    return run, "rid long, doc_id long, n_words long, text_hash long, own int, hash long, kind int, words binary, runs array<struct<begin:long,end:long>>"


def covered(spans: Column) -> Column:
    """How many positions a sorted array of (begin, end) covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["to"], x["begin"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside any shared window), items (sorted as strings),
    spans (begin, end: words, by begin; they may overlap) and text_hash (xxhash64 of the text), which tells rows of one
    id apart."""
    spark = docs.sparkSession
    small_batches(spark)
    run, schema = _items(window)
    items = materialise(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).mapInArrow(run, schema), "items")
    short = [r[0] for r in items.select("kind").filter(F.col("kind") < window).distinct().collect()]  # fewer than ``window`` values
    sent = spark.sparkContext.broadcast(_filter(items.select("hash")))
    run, schema = _texts(window, short, sent)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, schema)
    # written, since rows are numbered by their order in a task
    texts = materialise(texts, "windows")
    sent.destroy()
    # the least item of a window stands for it where only places matter
    named = items.groupBy("hash", "kind", "words").agg(F.min("item").alias("lead"))
    right = materialise(items.join(named, ["hash", "kind", "words"]).select("hash", "kind", "words", "item", F.coalesce(F.col("item") == F.col("lead"), F.col("lead").isNull()).alias("leads")).distinct(), "named")
    met = texts.filter("own IS NULL").select("rid", "hash", "kind", "words", "runs").join(right, ["hash", "kind", "words"])
    per = met.select("rid", "item", F.explode_outer(F.when(F.col("leads"), F.col("runs"))).alias("span")).groupBy("rid").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<struct<begin:long,end:long>>"), F.array().cast("array<string>")
    own = texts.filter("own IS NOT NULL").select("rid", "doc_id", "n_words", "text_hash", "own")
    clean = own.filter("own = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none[1].alias("items"), none[0].alias("spans"), "text_hash")
    rest = own.filter("own > 0").join(per, "rid", "left")
    hit = rest.select("doc_id", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none[1]).alias("items"), F.coalesce("spans", none[0]).alias("spans"), "text_hash")
    return clean.unionByName(hit)
