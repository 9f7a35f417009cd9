"""PCA whitening of embeddings.

Means and the covariance come from one pass each over the vectors, centred before they are multiplied; only matrices as
wide as a vector leave the tasks, and Spark adds their cells. The matrix of a length is made tridiagonal by Householder
reflections; Sturm counts bisect its leading eigenvalues; inverse iteration gives their vectors, held orthogonal to
those found before in a cluster of close values. Vectors are then projected by a broadcast model, whose size is checked:
models of more lengths than fit in MODEL_BYTES go out in several rounds.

Edge cases: null vectors and vectors with null or non-finite components take no part; a null id is kept, repeated rows
are rows of their own; vectors of different lengths are fitted apart, each length with its own ``n``; empty vectors have
no components and give no rows; components without variance (up to rounding) have ``whitened`` null, and ``explained`` 0
where nothing varies; ``deviation`` is null where it does not fit in a long. Components are told from rounding only
within a double's precision of the largest one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise
from .topk import usable

#: Rows that are multiplied at once, and bytes of models that go to the executors at once.
ROWS, MODEL_BYTES = 4096, 64 << 20
#: Eigenvalues closer than this share of the matrix's norm form a cluster.
CLOSE = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, next diagonal and reflections (one a row, of unit length or 0) of a symmetric matrix."""
    a = a.copy()
    n = len(a)
    mirrors = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        x = a[k + 1 :, k]
        norm = math.sqrt(float(x[1:] @ x[1:]))
        if norm == 0.0:
            continue
        v = x.copy()
        v[0] += math.copysign(math.hypot(norm, float(x[0])), float(x[0]))
        v /= math.sqrt(float(v @ v))
        mirrors[k, k + 1 :] = v
        w = a[k + 1 :, k + 1 :] @ v
        w -= (v @ w) * v
        a[k + 1 :, k + 1 :] -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2.0 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number of ``at`` how many eigenvalues of the tridiagonal matrix are smaller: negative pivots of a Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = np.zeros(len(at), np.int64), np.ones(len(at))
    for i in range(len(d)):
        pivot = d[i] - at - (e[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues by bisection, falling."""
    n = len(d)
    around = np.concatenate([[0.0], np.abs(e), [0.0]])
    reach = around[:-1] + around[1:]
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    high += np.finfo(float).eps * np.abs(high) + np.finfo(float).tiny
    rank = n - 1 - np.arange(k)
    while True:
        mid = low + (high - low) / 2
        if not ((mid > low) & (mid < high)).any():
            return mid
        right = below(d, e, mid) <= rank
        low, high = np.where(right, mid, low), np.where(right, high, mid)


def _solver(d: np.ndarray, e: np.ndarray, shift: float, least: float):
    """x for (T - shift) x = b, by elimination with row exchanges."""
    n = len(d)
    diag, up, up2 = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * n
    steps = []
    for i in range(n - 1):
        low = float(e[i])
        if abs(low) > abs(diag[i]):
            f = diag[i] / low
            diag[i], up[i], up2[i], diag[i + 1], up[i + 1] = low, diag[i + 1], up[i + 1], up[i] - f * diag[i + 1], -f * up[i + 1]
            steps.append((True, f))
        else:
            if abs(diag[i]) < least:
                diag[i] = math.copysign(least, diag[i])
            f = low / diag[i]
            diag[i + 1] -= f * up[i]
            steps.append((False, f))
    if n and abs(diag[-1]) < least:
        diag[-1] = math.copysign(least, diag[-1])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i, (swap, f) in enumerate(steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= f * x[i]
        for i in range(n - 1, -1, -1):
            x[i] -= (up[i] * x[i + 1] if i + 1 < n else 0.0) + (up2[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] /= diag[i]
        return np.array(x)

    return solve


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows; the component of each
    vector that is largest in size is positive."""
    n = len(a)
    k = min(k, n)
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    d, e, mirrors = tridiagonal(a / scale)
    values = leading(d, e, k)
    norm = float(max(np.abs(values).max(initial=0.0), np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0))) or 1.0
    eps = np.finfo(float).eps
    rng = np.random.default_rng(1)
    out = np.zeros((k, n))
    head = 0
    for i in range(k):
        if i and values[i - 1] - values[i] > CLOSE * norm:
            head = i
        # equal values of a cluster are moved apart, so that their solvers differ
        solve = _solver(d, e, values[i] - (i - head) * 4 * eps * norm, eps * norm)
        x = rng.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                x -= out[head:i].T @ (out[head:i] @ x)
            x /= np.abs(x).max() or 1.0
            x = solve(x)
            x /= math.sqrt(float(x @ x)) or 1.0
        for _ in range(2):
            x -= out[head:i].T @ (out[head:i] @ x)
        out[i] = x / math.sqrt(float(x @ x))
    for m in mirrors[::-1]:
        out -= 2.0 * np.outer(out @ m, m)
    out *= np.where(np.take_along_axis(out, np.abs(out).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
    return values * scale, out


def _groups(batches: Iterator[pa.RecordBatch]):
    """(batch, dim, rows of that length, their vectors as a matrix)."""
    for batch in batches:
        dims, v = batch.column(0).to_numpy(), batch.column(1)
        flat, begin = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            for i in range(0, len(rows), ROWS):
                part = rows[i : i + ROWS]
                yield batch, int(dim), part, flat[begin[part][:, None] + np.arange(dim)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, i, n, s): the sum of each dimension over a task's vectors, and how many they are."""
    total: dict[int, list] = {}
    for _, dim, part, x in _groups(batches):
        high, low = (x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0)
        have = total.setdefault(dim, [0, [0] * dim])
        have[0] += len(part)
        have[1] = [s + (int(h) << 24) + int(w) for s, h, w in zip(have[1], high, low, strict=True)]
    for dim, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(list(map(Decimal, s)), pa.decimal128(38, 0))], names=["dim", "i", "n", "s"])


def _products(means):
    """(dim, i, j, c) for i <= j: the sums of products of centred vectors over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, dim, _, x in _groups(batches):
            y = x - means.value[dim]
            total[dim] = total.get(dim, 0.0) + y.T @ y
        for dim, c in total.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(c[i, j])], names=["dim", "i", "j", "c"])

    return run


def _rounds(fits: DataFrame):
    """Lengths in lots whose matrices' sizes stay below MODEL_BYTES; at least one length a lot."""
    lot, size = [], 0
    for (dim,) in fits.select("dim").distinct().orderBy("dim").toLocalIterator():
        more = 8 * dim * max(dim, 32)
        if lot and size + more > MODEL_BYTES:
            yield lot
            lot, size = [], 0
        lot, size = [*lot, dim], size + more
    yield lot


def _fit(k: int):
    """A length's model from the cells of its covariance: (dim, values, vectors, trace)."""

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        v = np.zeros((dim, dim))
        v[cells["i"], cells["j"]] = v[cells["j"], cells["i"]] = cells["c"] / cells["n"]
        values, vectors = eigen(v, k)
        return pd.DataFrame({"dim": [dim], "values": [values.tolist()], "vectors": [vectors.ravel().tolist()], "trace": [float(np.trace(v))]})

    return run


def moments(rows: DataFrame) -> DataFrame:
    """(dim, i, n, s) of vectors of longs (dim, x): their number and exact sums."""
    found = rows.mapInArrow(_sums, "dim int, i int, n long, s decimal(38,0)")
    return materialise(found.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")), "moments")


def covariance(rows: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    """(dim, i, j, c), i <= j: sums of products of vectors (dim, x) about ``means``. Tasks' sums are added in one order
    whatever order they arrive in."""
    sent = rows.sparkSession.sparkContext.broadcast(means)
    found = rows.mapInArrow(_products(sent), "dim int, i int, j int, c double")
    # a cell has one number from each task
    add = F.aggregate(F.sort_array(F.collect_list("c")), F.lit(0.0), lambda s, x: s + x)
    out = materialise(found.groupBy("dim", "i", "j").agg(add.alias("c")), "covariance")
    sent.destroy()
    return out


def _project(models):
    """(vec_id, dim, deviation, w) of vectors (dim, x, vec_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, dim, part, x in _groups(batches):
            n, sums, mean, values, vectors, floor = models.value[dim]
            y = (x - mean) @ vectors.T
            ok = values > floor
            w = np.divide(y, np.sqrt(np.where(ok, values, 1.0)))
            if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
                off = n * x - np.array(sums, np.int64)
                # whole numbers beyond 64 bits where squares need them
                off = off if float(np.abs(off).max(initial=0)) ** 2 * dim < 2**62 else off.astype(object)
            else:
                off = n * x.astype(object) - np.array(sums, object)
            deviation = [int(s) if s < 1 << 63 else None for s in (off * off).sum(axis=1)]
            mask = np.broadcast_to(~ok, w.shape).ravel()
            lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * len(values), pa.array(w.ravel(), mask=mask))
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(part)), pa.array(np.full(len(part), dim, np.int32)), pa.array(deviation, pa.int64()), lists], names=["vec_id", "dim", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, *, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The whitened vectors (vec_id, dim, n, deviation, w) of the whole numbers floor(scale * c) + shift, and the models
    (dim, n, trace, values, vectors, error), error being the largest entry of w's covariance minus the identity."""
    spark = vectors.sparkSession
    x = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))
    rows = vectors.filter(usable(F.col(vector_col)) & (F.size(vector_col) > 0)).select(F.size(vector_col).alias("dim"), x.alias("x"), F.col(id_col).alias("vec_id"))
    known = moments(rows.select("dim", "x"))
    done, fitted = None, None
    for lot in _rounds(known):
        here = rows.filter(F.col("dim").isin(lot))
        sums: dict[int, list] = {dim: [0] * dim for dim in lot}
        n: dict[int, int] = {}
        for r in known.filter(F.col("dim").isin(lot)).toLocalIterator():  # a row for each dimension
            sums[r["dim"]][r["i"]], n[r["dim"]] = int(r["s"]), r["n"]
        means = {dim: np.array([s / n[dim] for s in sums[dim]]) for dim in n}
        cells = covariance(here.select("dim", "x"), means).join(known.select("dim", "n").distinct(), "dim")
        fits = materialise(cells.groupBy("dim").applyInPandas(_fit(components), "dim int, values array<double>, vectors array<double>, trace double"), "models")
        models = {r["dim"]: (n[r["dim"]], sums[r["dim"]], means[r["dim"]], np.array(r["values"]), np.array(r["vectors"]).reshape(-1, r["dim"]), r["dim"] * np.finfo(float).eps * r["trace"]) for r in fits.toLocalIterator()}
        sent = spark.sparkContext.broadcast(models)
        w = materialise(here.mapInArrow(_project(sent), f"vec_id {vectors.schema[id_col].dataType.simpleString()}, dim int, deviation long, w array<double>"), "whitened")
        sent.destroy()
        done = w if done is None else done.unionByName(w)
        fitted = fits if fitted is None else fitted.unionByName(fits)
    counts = known.select("dim", "n").distinct()
    models = materialise(fitted.join(counts, "dim").join(_errors(done, components), "dim", "left"), "models")
    return done.join(counts, "dim"), models


def _errors(whitened: DataFrame, components: int) -> DataFrame:
    """(dim, error): how far the covariance of w, over components that vary, is from the identity."""
    w = lambda i: F.element_at("w", i + 1)
    there = whitened.select("dim", *(F.when(F.size("w") > i, w(i)).alias(f"w{i}") for i in range(components)))
    mean = there.groupBy("dim").agg(F.count("*").alias("n"), *(F.avg(f"w{i}").alias(f"m{i}") for i in range(components)))
    off = there.join(F.broadcast(mean) if mean.count() <= 10_000 else mean, "dim").select("dim", "n", *((F.col(f"w{i}") - F.col(f"m{i}")).alias(f"w{i}") for i in range(components)))
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    cov = off.groupBy("dim").agg(*((F.sum(F.col(f"w{i}") * F.col(f"w{j}")) / F.first("n")).alias(f"c{i}_{j}") for i, j in pairs))
    return cov.select("dim", F.greatest(F.lit(0.0), *(F.coalesce(F.abs(F.col(f"c{i}_{j}") - float(i == j)), F.lit(0.0)) for i, j in pairs)).alias("error"))
