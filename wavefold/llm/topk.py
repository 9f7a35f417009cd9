"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are cut into ``lists`` slices of their dimensions, and each slice is a list of local scores for each query; a
score is the sum of its local ones. First every list gives its highest local scores, and the exact scores of what they
name set a safe cutoff for each query: the k-th of them. Then every list gives all entries of at least cutoff / lists;
what no list gives is below the cutoff. Last, the scores that are still incomplete are resolved from the vectors.

Equal vectors form a class with its k + 1 smallest ids, so that ties among copies need no pairs. Queries meet candidates
in blocks of bounded size, joined by block number.

Edge cases: null vectors and vectors with null or non-finite components take no part; vectors of different lengths are
not compared; empty vectors score 0; ties go to the smaller id; rows that repeat an id count once for each vector.
Scores must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Rows in a block of candidates and of queries.
BLOCK = 2048
LISTS = 2


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(k: int):
    """The k highest local scores of each query of a block in each block of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, c_ids, local, _ in _local(batches):
            n = min(k, len(c_ids))
            at = np.argpartition(-local, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(c_ids[at].ravel()), pa.array(np.take_along_axis(local, at, 1).ravel())], names=["q", "c", "local"])

    return run


def _above(lists: int):
    """All entries whose local score is at least the cutoff's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, c_ids, local, cutoff in _local(batches):
            # local * lists >= cutoff in whole numbers
            row, col = np.nonzero(local >= -((-cutoff) // lists)[:, None])
            for i in range(0, len(row), 100_000):
                r, c = row[i : i + 100_000], col[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(c_ids[c]), pa.array(local[r, c])], names=["q", "c", "local"])

    return run


def _matrix(rows: pa.StructArray, lists: list[str]) -> list[np.ndarray]:
    """Columns of a block's rows as arrays; ``part`` as a matrix."""
    cols = dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))
    out = [cols["id"].to_numpy(zero_copy_only=False), cols["part"].flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)]
    return out + [cols[c].fill_null(-(1 << 62)).to_numpy(zero_copy_only=False) for c in lists]


def _local(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for q, c in zip(batch.column(0), batch.column(1), strict=True):
            q_ids, a, cutoff = _matrix(q.values, ["cutoff"])
            c_ids, b = _matrix(c.values, [])
            yield q_ids, c_ids, _product(a, b), cutoff


def _blocks(rows: DataFrame, extra: list[str], lists: int) -> DataFrame:
    """Slices of rows (id, dim, v) in blocks: (dim, list, block, rows)."""
    parts = [F.struct(F.lit(i).alias("list"), F.slice("v", F.floor(F.col("dim") * i / lists).cast("int") + 1, (F.floor(F.col("dim") * (i + 1) / lists) - F.floor(F.col("dim") * i / lists)).cast("int")).alias("part")) for i in range(lists)]
    cut = rows.withColumn("s", F.explode(F.array(*parts)))
    return cut.groupBy("dim", F.col("s.list").alias("list"), "block").agg(F.collect_list(F.struct("id", F.col("s.part").alias("part"), *extra)).alias("rows"))


def _pairs(queries: DataFrame, candidates: DataFrame, lists: int) -> DataFrame:
    q = _blocks(queries, ["cutoff"], lists).select("dim", "list", F.col("rows").alias("q_rows"))
    n = candidates.select("dim", "block").distinct().groupBy("dim").agg(F.max("block").alias("last"))
    q = q.join(n, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    c = _blocks(candidates, [], lists).withColumnRenamed("rows", "c_rows")
    return q.join(c, ["dim", "list", "block"]).select("q_rows", "c_rows")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("c"))
    return scores.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, lists: int = LISTS, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row where ``is_query`` (over the id column) holds its k best other rows: query_id, rank, vec_id, score."""
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asks"), quantised(F.col(vector_col), scale).alias("v"))
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.select("vec_id", "v").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    classes = kept.groupBy("v").agg(F.min("vec_id").alias("c"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = materialise(classes.withColumn("dim", F.size("v")), "classes")
    asking = materialise(rows.filter("asks").select("vec_id", "v").join(classes.select("v", F.col("c").alias("q")), "v").select("vec_id", "q").distinct(), "asking")
    spread = classes.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cand = materialise(classes.join(F.broadcast(spread), "dim").select(F.col("c").alias("id"), "dim", "v", F.pmod(F.xxhash64("c"), "blocks").alias("block")), "candidates")
    ask = cand.drop("block").join(asking.select(F.col("q").alias("id")).distinct(), "id", "left_semi")
    spread = ask.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    ask = materialise(ask.join(F.broadcast(spread), "dim").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks"), "queries")
    # k + 1 classes hold k rows besides the query itself
    top = materialise(_pairs(ask.withColumn("cutoff", F.lit(None).cast("long")), cand, lists).mapInArrow(_best(k + 1), "q long, c long, local long"), "phase1")
    named = top.select("q", "c").distinct()
    q_side = ask.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    c_side = cand.select(F.col("id").alias("c"), F.col("v").alias("cv"))
    scored = named.join(c_side, "c").join(q_side, "q").select("q", "c", _dot("qv", "cv").alias("score"))
    cutoff = _ranked(scored, k + 1).groupBy("q").agg(F.when(F.count("*") == k + 1, F.min("score")).alias("cutoff"))
    ask_cut = materialise(ask.join(cutoff.withColumnRenamed("q", "id"), "id", "left"), "cutoff")
    entries = _pairs(ask_cut, cand, lists).mapInArrow(_above(lists), "q long, c long, local long")
    part = materialise(entries.groupBy("q", "c").agg(F.sum("local").alias("seen"), F.count("*").alias("n")), "phase2")
    whole = part.filter(F.col("n") == lists).select("q", "c", F.col("seen").alias("score"))
    rest = part.filter(F.col("n") < lists).select("q", "c").join(c_side, "c").join(q_side, "q").select("q", "c", _dot("qv", "cv").alias("score"))
    best = materialise(_ranked(whole.unionByName(rest), k + 1).drop("r"), "phase3")
    hits = asking.join(best, "q").join(classes.select("c", "ids"), "c").select(F.col("vec_id").alias("query_id"), "score", F.explode("ids").alias("vec_id")).filter("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
