"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets form a class, and one row stands for it. What follows loses no link:

1. By prefix filtering, two linked sets share at least so many of their first shingles in the order of hashes. Classes
   that share too few of them with any other class link with none and are done.
2. Similar classes are put into groups of bounded size: those with the same least hash (under two orders), dealt out
   by a hash where a group is large. Inside a group all links are found, and linked classes join a component.
3. A class can link outside its component only if enough of its shingles occur in another component. Those classes are
   grouped again, by component or, where they are alone in theirs, by similarity, again in groups of bounded size. Two
   groups meet if their token matrices share one of the rarest shingles of members of both. Then each class of the one
   is held against the union of the other's shingles, which bounds its overlap with any member, and only where the
   bound reaches the threshold is the group opened and its members compared.

Shingles are 64-bit hashes of words; classes are told apart by digests of 128 bits. Edge cases: null or empty texts and texts without words have no shingles and no
links; texts of fewer than ``k`` words have the whole as one shingle; a null id gives a null component and no links;
repeated rows and ids are one class and give one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NOT_SPACE, blocks, grams, materialise, mix, signed, small_batches, words
from .graph import components

#: About as many members has a group at most.
GROUP = 256
#: About so many bytes of text have their tokens met in one partition.
PART_BYTES = 1 << 25
#: Share of a set by which the prefix is longer than the plain filter needs, for more than one shared shingle.
EXTRA = 0.12
_U = np.uint64


@dataclass(frozen=True)
class Threshold:
    """Sets of sizes a and b link when ``den * overlap >= num * union``."""

    k: int
    num: int
    den: int

    def least(self, n):
        """The least overlap a set of n can have with a linked set."""
        return -(-self.num * n // self.den)

    def extra(self, n):
        return 1 + (EXTRA * n).astype(np.int64) if isinstance(n, np.ndarray) else 1 + int(EXTRA * n)

    def prefix(self, n: int) -> int:
        return min(n, n - self.least(n) + self.extra(n))

    def linked(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(texts, NOT_SPACE)
    g = grams(w.hashes, k) if len(w.hashes) >= k else np.zeros(0, _U)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            yield grams(w.hashes[a:b], b - a) ^ _U(b - a)
        else:
            yield np.zeros(0, _U)


def _signature(x: np.ndarray) -> tuple[int, int]:
    """A digest of a set, in two halves of 64 bits; the first is 0 for the empty set only."""
    if not len(x):
        return 0, 0
    a, b = (mix(mix(x ^ _U(seed)).sum(dtype=_U, keepdims=True) + _U(len(x))).view(np.int64)[0] for seed in (0, 0x5555555555555555))
    return int(a) or 1, int(b)


def _deal(group: np.ndarray, token: np.ndarray, buckets: int, into: list) -> np.ndarray:
    """Which entries' tokens are met with another group right here; the rest, one row for each token, go into buckets.
    However frequent a token is, at most one row of it leaves each call: group 0 says that it is shared already."""
    order = np.lexsort((group, token))
    t, g = token[order], group[order]
    head = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    low, high = g[at], g[np.concatenate([at[1:], [len(t)]]) - 1] if len(at) else g[at]
    several = low != high
    shared = np.empty(len(t), bool)
    shared[order] = np.repeat(several, np.diff(np.concatenate([at, [len(t)]])))
    sent_t, sent_g = t[at], np.where(several, 0, low)
    bucket = (sent_t % _U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        part = by[cuts[i] : cuts[i + 1]]
        into.append((i, sent_t[part].tobytes(), sent_g[part].astype(np.int64).tobytes()))
    return shared


_DEALT = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("grp", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("sig2", pa.int64()), ("tokens", pa.binary()), ("groups", pa.binary())])
DEALT = "bucket long, kind int, id long, grp long, n long, key long, sig2 long, tokens binary, groups binary"
MET = "kind int, id long, grp long, n long, key long, sig2 long"
#: Kinds of rows: a document (id, its set's digest as grp and sig2, size n, its text's hash as key); a count n of shared
#: tokens of grp; blobs.
DOC, COUNT, BLOB = 0, 1, 2


def _rows(kind: int, rows: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    n = len(rows)
    if n:
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        spread = pa.array((np.arange(n, dtype=np.int64) * 40503 + n) % buckets)  # they may go anywhere
        yield pa.RecordBatch.from_arrays([spread, pa.array(np.full(n, kind, np.int32)), *cols, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=_DEALT)


def _blobs(dealt: list[tuple]) -> Iterator[pa.RecordBatch]:
    if dealt:
        b, t, g = zip(*dealt, strict=True)
        no = pa.nulls(len(b), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(np.full(len(b), BLOB, np.int32)), no, no, no, no, no, pa.array(t, pa.binary()), pa.array(g, pa.binary())], schema=_DEALT)


def _dealt(groups: list[int], tokens: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of what is shared right here, and the rest of the tokens in blobs."""
    if not tokens:
        return
    sizes = [len(x) for x in tokens]
    dealt: list = []
    shared = _deal(np.repeat(np.array(groups, np.int64), sizes), np.concatenate(tokens), buckets, dealt)
    n = np.add.reduceat(shared, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
    yield from _rows(COUNT, [(None, g, c, None, None) for g, c in zip(groups, n.tolist(), strict=True) if c], buckets)
    yield from _blobs(dealt)


def _first_pass(th: Threshold, buckets: int):
    """Each document's (id, signature, size), and its first shingles dealt by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            own, first = [], {}
            for i, key, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(texts, th.k), strict=True):
                s, second = _signature(x)
                own.append((i, s, len(x), key, second))
                if len(x) and i is not None and s not in first:
                    first[s] = x[: th.prefix(len(x))]
            yield from _rows(DOC, own, buckets)
            yield from _dealt(list(first), list(first.values()), buckets)

    return run


def _set_pass(buckets: int):
    """Tokens of rows (comp, tokens) dealt likewise, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            comps, tokens = batch.column(0).to_pylist(), [np.frombuffer(x, _U) for x in batch.column(1).to_pylist()]
            at = 0
            while at < len(tokens):
                till, size = at, 0
                while till < len(tokens) and (till == at or size + len(tokens[till]) < 400_000):
                    size += len(tokens[till])
                    till += 1
                yield from _dealt(comps[at:till], tokens[at:till], buckets)
                at = till

    return run


#: Buckets are settled together up to about so many tokens.
TOGETHER = 1_000_000


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens of each group another group has too, from rows in order of buckets, of which few are held at once;
    other rows pass."""
    tokens, groups, held, last = [], [], 0, None
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        blob = batch.column(1).to_numpy(zero_copy_only=False) == BLOB
        if not blob.all():
            own = batch.filter(pa.array(~blob))
            yield pa.RecordBatch.from_arrays([own.column(i) for i in range(1, 7)], names=["kind", "id", "grp", "n", "key", "sig2"])
        picked = batch.filter(pa.array(blob))
        for bucket, t, g in zip(picked.column(0).to_pylist(), picked.column(7).to_pylist(), picked.column(8).to_pylist(), strict=True):
            if bucket != last and held >= TOGETHER:
                counts.append(_shared(tokens, groups))
                tokens, groups, held = [], [], 0
                if sum(len(x) for x, _ in counts) >= TOGETHER:
                    yield _counted(counts)
                    counts = []
            last = bucket
            tokens.append(np.frombuffer(t, _U))
            groups.append(np.frombuffer(g, np.int64))
            held += len(tokens[-1])
    if tokens:
        counts.append(_shared(tokens, groups))
    if counts:
        yield _counted(counts)


def _shared(tokens: list[np.ndarray], groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Groups, and how many of their tokens others have too."""
    t, g = np.concatenate(tokens), np.concatenate(groups)
    order = np.argsort(t, kind="stable")
    t, g = t[order], g[order]
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    several = np.minimum.reduceat(g, at) != np.maximum.reduceat(g, at)
    several |= np.maximum.reduceat((g == 0).astype(np.int8), at) > 0
    shared = np.repeat(several, np.diff(np.concatenate([at, [len(t)]])))
    return np.unique(g[shared & (g != 0)], return_counts=True)


def _counted(counts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids, place = np.unique(np.concatenate([x for x, _ in counts]), return_inverse=True)
    n = np.bincount(place, np.concatenate([y for _, y in counts]), len(ids)).astype(np.int64)
    no = pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), COUNT, np.int32)), no, pa.array(ids), pa.array(n), no, no], names=["kind", "id", "grp", "n", "key", "sig2"])


def _local_links(th: Threshold):
    """All links inside a group of at most GROUP classes, as each class's least linked neighbour chain."""

    def run(key, pdf):
        pdf = pdf.sort_values("id", ignore_index=True)
        label = link_block([np.frombuffer(x, _U) for x in pdf["tokens"]], pdf["n"].to_numpy(), th)
        return pd.DataFrame({"a": pdf["id"], "b": pdf["id"].to_numpy()[label]})

    return run


def link_block(sets: list[np.ndarray], n: np.ndarray, th: Threshold) -> np.ndarray:
    """For each set of a block the first set of its component, all links inside the block considered."""
    m = len(sets)
    label = np.arange(m)
    if m < 2:
        return label
    cat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(cat, kind="stable")
    t, o = cat[order], owner[order]
    at = np.concatenate([np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])), [len(t)]])
    code = np.empty(len(t), np.int64)
    code[order] = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bounds = np.concatenate([[0], np.cumsum(n)])
    width = np.diff(at)
    for i in range(m):
        mine = code[bounds[i] : bounds[i + 1]]
        mine = mine[width[mine] > 1]
        if not len(mine):
            continue
        starts, w = at[mine], width[mine]
        place = np.repeat(starts - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(w.sum())
        overlap = np.bincount(o[place], minlength=m)
        near = np.flatnonzero(th.linked(overlap, n[i], n))
        for j in near[near > i].tolist():
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
    return label


def _links_to(th: Threshold, sets: list[np.ndarray], n: np.ndarray, comps: np.ndarray, queries: list[np.ndarray], sizes: np.ndarray, own: np.ndarray) -> set[tuple[int, int]]:
    """Links (component, component) of queries with members of a group: first the bound by the group's union."""
    cat = np.concatenate(sets)
    order = np.argsort(cat, kind="stable")
    t, o = cat[order], np.repeat(np.arange(len(sets)), n)[order]
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    union, ends = t[at], np.concatenate([at[1:], [len(t)]])
    out = set()
    for x, size, comp in zip(queries, sizes.tolist(), own.tolist(), strict=True):
        place = np.minimum(np.searchsorted(union, x), len(union) - 1)
        place = place[union[place] == x]
        if len(place) < th.least(size):
            continue
        w = ends[place] - at[place]
        every = np.repeat(at[place] - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(w.sum())
        linked = th.linked(np.bincount(o[every], minlength=len(sets)), size, n) & (comps != comp)
        out |= {(comp, int(c)) for c in comps[linked]}
    return out


def _open(th: Threshold):
    """Links between the components of two groups of sets."""

    def run(key, one, other):
        found = set()
        if len(one) and len(other):
            a, b = ([np.frombuffer(x, _U) for x in pdf["tokens"]] for pdf in (one, other))
            found = _links_to(th, a, one["n"].to_numpy(), one["comp"].to_numpy(), b, other["n"].to_numpy(), other["comp"].to_numpy())
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return run


def _inside(th: Threshold):
    """Links between the components inside one group."""

    def run(key, pdf):
        sets = [np.frombuffer(x, _U) for x in pdf["tokens"]]
        n, comps = pdf["n"].to_numpy(), pdf["comp"].to_numpy()
        return pd.DataFrame(sorted(_links_to(th, sets, n, comps, sets, n, comps)), columns=["a", "b"], dtype="int64")

    return run


def _tokenise(th: Threshold):
    """The sets of documents, with their least hashes under two orders."""
    schema = pa.schema([("sig", pa.int64()), ("sig2", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("key1", pa.int64()), ("key2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches, "text"):
            rows = []
            for x in shingle_sets(texts, th.k):
                if len(x):
                    rows.append((*_signature(x), len(x), x.tobytes(), int(x[:1].view(np.int64)[0]), int(mix(x ^ _U(0x0123456789ABCDEF)).min(keepdims=True).view(np.int64)[0])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run, "sig long, sig2 long, n long, tokens binary, key1 long, key2 long"


#: Counters of the token order. Any order is right; by these counts rare tokens come first.
SKETCH = 1 << 20


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            slots = (np.frombuffer(x, _U) % _U(SKETCH)).astype(np.int64)
            np.add.at(counts, slots, 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])


def _prefixes(th: Threshold, counts):
    """(token, grp, comp, n) for the rarest tokens of each set, as many as a linked set must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for x in batch.column(3).to_pylist():
                t = np.frombuffer(x, _U)
                order = np.lexsort((t, counts.value[(t % _U(SKETCH)).astype(np.int64)]))
                tokens.append(t[order[: len(t) - th.least(len(t)) + 1]])
            if tokens:
                lens = [len(t) for t in tokens]
                rest = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), lens)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), *rest], names=["token", "grp", "comp", "n"])

    return run


def _grouped(sets: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with a column grp, equal for sets with an equal key, and at most about GROUP of them: larger ones are dealt
    into parts by a hash. Sets alone with their key go."""
    counts = materialise(sets.groupBy(key).agg(F.count("*").alias("members")).filter("members > 1"), "counts")
    return sets.join(counts, key).withColumn("grp", F.xxhash64(F.col(key), F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("members") / GROUP))))


def _across(sets: DataFrame, th: Threshold) -> DataFrame:
    """Links (a, b) between components of ``sets`` (id, comp, n, tokens, key1, key2), through the token-group matrix."""
    spark = sets.sparkSession
    tally = sets.select("tokens").mapInArrow(_tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = tally.toArrow()  # at most SKETCH rows
    counts = np.zeros(SKETCH, np.int64)
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    # sets of one component together; those alone in theirs by the more frequent of their least hashes
    slim = sets.select("id", "comp", "key1", "key2")
    for key in ("comp", "key1", "key2"):
        slim = slim.join(materialise(slim.groupBy(key).agg(F.count("*").alias(f"n_{key}")), "sizes"), key)
    alike = F.when(F.struct("n_key1", "key1") >= F.struct("n_key2", "key2"), F.struct("n_key1", "key1")).otherwise(F.struct(F.col("n_key2").alias("n_key1"), F.col("key2").alias("key1")))
    about = F.when(F.col("n_comp") > 1, F.struct(F.col("n_comp").alias("n_key1"), F.col("comp").alias("key1"))).otherwise(alike)
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(about["n_key1"] / GROUP))
    groups = materialise(slim.select("id", F.xxhash64(about["key1"], F.col("n_comp") > 1, part).alias("grp")), "groups")
    sets = materialise(sets.join(groups, "id").select("grp", "comp", "n", "tokens"), "members")
    sent = spark.sparkContext.broadcast(counts)
    prefix = sets.mapInArrow(_prefixes(th, sent), "token long, grp long, comp long, n long")
    matrix = prefix.groupBy("token", "grp").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = materialise(matrix, "matrix")
    sent.destroy()
    # tokens of one component alone join nothing; of a token's groups those wholly of its most frequent component are
    # only held against the others, so that a large component's groups don't all meet one another
    pure = F.when(F.col("c1") == F.col("c2"), F.col("c1"))
    by_comp = matrix.groupBy("token", pure.alias("c")).agg(F.count("*").alias("m"), F.min("c1").alias("c1"), F.max("c2").alias("c2"))
    main = by_comp.groupBy("token").agg(F.max_by("c", F.struct(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0), "c")).alias("main"), F.min("c1").alias("least"), F.max("c2").alias("most"))
    matrix = matrix.join(main.filter("least <> most").select("token", "main"), "token").withColumn("at_main", F.coalesce(pure == F.col("main"), F.lit(False))).drop("main")
    matrix = materialise(matrix, "shared_tokens")
    a, b = (matrix.select("token", *(F.col(c).alias(f"{c}_{x}") for c in matrix.columns if c != "token")) for x in "ab")
    fits = (F.col("low_a") * th.num <= F.col("high_b") * th.den) & (F.col("low_b") * th.num <= F.col("high_a") * th.den)
    alone = (F.col("c1_a") == F.col("c2_a")) & (F.col("c1_b") == F.col("c2_b")) & (F.col("c1_a") == F.col("c1_b"))
    once = F.col("at_main_a") | (F.col("grp_a") < F.col("grp_b"))
    pairs = a.join(b.filter("NOT at_main_b"), "token").filter(once & (F.col("grp_a") != F.col("grp_b")) & fits & ~alone)
    met = materialise(pairs.select(F.least("grp_a", "grp_b").alias("grp_a"), F.greatest("grp_a", "grp_b").alias("grp_b")).distinct(), "met")
    cols = ["grp_a", "grp_b", "comp", "n", "tokens"]
    one, other = (met.join(sets, met[g] == sets["grp"]).select(*(F.col(c).alias(c) for c in cols)).groupBy("grp_a", "grp_b") for g in ("grp_a", "grp_b"))
    between = one.cogroup(other).applyInPandas(_open(th), "a long, b long")
    mixed = sets.groupBy("grp").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("grp")
    inside = sets.join(materialise(mixed, "mixed"), "grp", "left_semi").groupBy("grp").applyInPandas(_inside(th), "a long, b long")
    return between.unionByName(inside)


#: Bits of the filter for the ids of documents that are read again; at most as many numbers come to the driver.
FILTER_BITS = 1 << 22


def _again(slim: DataFrame, left: DataFrame):
    """Rows of ``slim`` whose id may be in ``left``: all that are, and others by chance; and what was broadcast for it."""
    spark = slim.sparkSession
    slot = F.xxhash64("id").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    found = left.select(slot.cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    bits = np.zeros(FILTER_BITS, np.uint8)
    bits[found] = 1
    sent = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            keep = batch.filter(pa.array(mask[batch.column(0).to_numpy(zero_copy_only=False)]))
            if keep.num_rows:
                yield keep

    return slim.filter("id IS NOT NULL").select(slot.cast("int").alias("slot"), "text").mapInArrow(run, "slot int, text string").select("text"), sent


def join(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least doc_id reachable by links), and text_hash
    (xxhash64 of the text), which tells rows of one id apart."""
    spark = docs.sparkSession
    th = Threshold(k, num, den)
    small_batches(spark)
    # partitions follow the data; many more buckets than partitions, so that these are even
    parts = max(8, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // PART_BYTES))
    buckets = max(2048, 16 * parts)
    meet = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, MET)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = slim.withColumn("key", F.xxhash64("text"))
    met = materialise(meet(keyed.mapInArrow(_first_pass(th, buckets), DEALT)), "first")
    base = met.filter(F.col("kind") == DOC).select("id", F.col("grp").alias("sig"), "sig2", "n", F.col("key").alias("text_hash"))
    counts = met.filter(F.col("kind") == COUNT).groupBy("grp").agg(F.sum("n").alias("shared"))
    classes = materialise(base.filter("id IS NOT NULL AND n > 0").groupBy("sig", "sig2").agg(F.min("id").alias("rep"), F.first("n").alias("n")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    least = F.ceil(F.col("n") * th.num / th.den)
    needs = 1 + F.floor(F.lit(EXTRA) * least).cast("long")
    left = classes.join(counts, F.col("sig") == F.col("grp")).filter(F.col("shared") >= needs).select(F.col("rep").alias("id"), "sig", "sig2", "cls")
    left = materialise(left, "left")
    run, schema = _tokenise(th)
    again, sent = _again(slim, left)
    again = again.mapInArrow(run, schema)
    sets = again.join(left.select("sig", "sig2", F.col("cls").alias("id")), ["sig", "sig2"]).drop("sig", "sig2")
    sets = materialise(sets.dropDuplicates(["id"]), "sets")
    sent.destroy()
    edges = None
    for key, seed in (("key1", 1), ("key2", 2)):
        found = _grouped(sets, key, seed).select("grp", "id", "n", "tokens").groupBy("grp").applyInPandas(_local_links(th), "a long, b long").filter("a <> b")
        edges = found if edges is None else edges.unionByName(found)
    local = materialise(components(edges, "a", "b"), "local")
    sets = sets.join(local, sets["id"] == local["node"], "left").select("id", F.coalesce("component", "id").alias("comp"), "n", "tokens", "key1", "key2")
    sets = materialise(sets, "labelled")
    # component 0 would be the mark of shared tokens
    cross = meet(sets.select((F.col("comp") + 1).alias("comp"), "tokens").mapInArrow(_set_pass(buckets), DEALT)).withColumn("grp", F.col("grp") - 1)
    cross = cross.groupBy("grp").agg(F.sum("n").alias("shared"))
    low = sets.groupBy("comp").agg(F.min("n").alias("low"))
    some = low.join(cross, F.col("comp") == F.col("grp")).filter(F.col("shared") >= F.ceil(F.col("low") * th.num / th.den)).select("comp")
    sets_left = materialise(sets.join(materialise(some, "some"), "comp", "left_semi"), "open")
    more = materialise(components(_across(sets_left, th), "a", "b"), "more")
    names = sets.select(F.col("id").alias("cls"), "comp").join(more, F.col("comp") == F.col("node"), "left").select("cls", F.coalesce("component", "comp").alias("comp"))
    named = materialise(names.join(classes, "cls").select("cls", "comp", "rep"), "named")
    least_of = materialise(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    ids = named.join(least_of, "comp").select("cls", "component_id")
    full = materialise(classes.join(ids, "cls", "left").select("sig", "sig2", F.coalesce("component_id", "rep").alias("class_id")), "components")
    out = base.join(full, ["sig", "sig2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("class_id"))).otherwise(F.col("id")).alias("component_id"), "text_hash")
