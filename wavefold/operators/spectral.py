"""Triangular truncation of a field of one hemisphere by spherical harmonics.

The field is mirrored at its southernmost row, and the rows of both halves are taken to lie evenly from pole to pole (by
their numbers; the latitudes themselves do not enter). Waves along a latitude are sums over its cells; the integral over
latitudes is exact for the row's cosine (even waves) or sine series (odd ones), so that harmonics up to the truncation
come back as they are, and higher ones that the rows resolve go."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def legendre(theta: np.ndarray, truncation: int) -> dict[tuple[int, int], np.ndarray]:
    """Associated Legendre functions (m, l) at colatitudes, of unit square integral, by recurrence in l."""
    x, s, out = np.cos(theta), np.sin(theta), {}
    sector = np.full_like(x, math.sqrt(0.5))
    for m in range(truncation + 1):
        if m:
            sector = math.sqrt((2 * m + 1) / (2 * m)) * s * sector
        below, here = np.zeros_like(x), sector
        for l in range(m, truncation + 1):  # noqa: E741
            out[m, l] = here
            up = l + 1
            a = math.sqrt((4 * up * up - 1) / (up * up - m * m))
            b = math.sqrt((l * l - m * m) / (4 * l * l - 1)) if l else 0.0
            below, here = here, a * (x * here - b * below)
    return out


def basis(n_lat: int, truncation: int) -> pd.DataFrame:
    """(lat_idx, m, l, weight, value): what a latitude's wave m adds to harmonic (m, l), and the harmonic's size there. Of
    a mirrored field harmonics of odd l + m are 0 and left out. About n_lat * truncation^2 / 4 rows, whatever the field's size."""
    rows = 2 * n_lat
    fine = (np.arange(rows + truncation + 1) + 0.5) * math.pi / (rows + truncation + 1)
    k = np.arange(1, len(fine) // 2 + 1)
    # weights of the fine nodes, exact for polynomials of the degrees that come up
    w = 2 / len(fine) * (1 - 2 * (np.cos(2 * np.outer(fine, k)) / (4 * k * k - 1)).sum(axis=1))
    at = (n_lat - 1 - np.arange(n_lat)) * math.pi / (rows - 1)
    k = np.arange(rows)
    half = np.where((k == 0) | (k == rows - 1), 0.5, 1.0)
    end = np.where(np.arange(n_lat) == n_lat - 1, 0.5, 1.0)
    # how much of a row's value the series through all rows has at each fine node
    even = 2 / (rows - 1) * end[:, None] * (np.cos(np.outer(at, k)) * half) @ np.cos(np.outer(k, fine))
    odd = 2 / (rows - 1) * np.sin(np.outer(at, k[:-1])) @ np.sin(np.outer(k[:-1], fine))
    there, here = legendre(fine, truncation), legendre(at, truncation)
    parts = [pd.DataFrame({"lat_idx": np.arange(n_lat), "m": m, "l": l, "weight": 2 * ((odd if m % 2 else even) @ (w * there[m, l])), "value": here[m, l]}) for m, l in there if (m + l) % 2 == 0]
    return pd.concat(parts, ignore_index=True)


def truncate(df: DataFrame, truncation: int = 21, *, n_lat: int, n_lon: int, value: str = "v") -> DataFrame:
    """(time, lat_idx, lon_idx, value) of a field whose rows ascend from the equator's side: its part of total wave numbers
    up to ``truncation``. A cell that is missing or null counts as 0; only cells that ``df`` has come back. A latitude's
    waves are one aggregate over its cells, harmonics one over latitudes, and the way back is one over harmonics."""
    if truncation < 0 or truncation > 2 * n_lat - 1 or 2 * truncation >= n_lon:
        raise ValueError(f"{n_lat} x {n_lon} cells of a hemisphere do not resolve wave number {truncation}")
    turn = 2 * math.pi / n_lon
    angle = lambda m: F.lit(turn) * F.pmod(m * F.col("lon_idx"), F.lit(n_lon))
    table = df.sparkSession.createDataFrame(basis(n_lat, truncation), "lat_idx int, m int, l int, weight double, value double")
    # one row for a latitude, before rows leave their tasks
    sums = [F.sum(F.col(value) * f(angle(F.lit(m)))).alias(f"{name}{m}") for m in range(truncation + 1) for name, f in (("c", F.cos), ("s", F.sin))]
    waves = df.groupBy("time", "lat_idx").agg(*sums).select("time", "lat_idx", *(F.array(*(F.coalesce(f"{x}{m}", F.lit(0.0)) for m in range(truncation + 1))).alias(x) for x in "cs"))
    of = lambda x: F.element_at(x, F.col("m") + 1)
    harmonics = waves.join(table.drop("value"), "lat_idx").groupBy("time", "m", "l").agg(F.sum(F.col("weight") * of("c")).alias("c"), F.sum(F.col("weight") * of("s")).alias("s"))
    back = harmonics.join(table.drop("weight"), ["m", "l"]).groupBy("time", "lat_idx", "m").agg(F.sum(F.col("value") * F.col("c")).alias("c"), F.sum(F.col("value") * F.col("s")).alias("s"))
    spectrum = back.groupBy("time", "lat_idx").agg(F.sort_array(F.collect_list(F.struct("m", "c", "s"))).alias("waves"))
    at = lambda x: x["c"] * F.cos(angle(x["m"])) + x["s"] * F.sin(angle(x["m"]))
    total = F.aggregate("waves", F.lit(0.0), lambda sum_, x: sum_ + F.when(x["m"] == 0, x["c"]).otherwise(2 * at(x)))
    return df.select("time", "lat_idx", "lon_idx").join(spectrum, ["time", "lat_idx"]).select("time", "lat_idx", "lon_idx", (total / n_lon).alias(value))
