"""Truncation: harmonics of few waves stay as they are, those of more go."""

import math

import numpy as np
import pytest

from wavefold import schema
from wavefold.operators import spectral


def grid(spark, f, rows=14, cols=24, times=(0,)):
    """f(t, colatitude, longitude) on rows that ascend to the pole."""
    at = [(rows - 1 - i) * math.pi / (2 * rows - 1) for i in range(rows)]
    return spark.createDataFrame([(t, i, j, 90 - math.degrees(at[i]), 360.0 * j / cols, float(f(t, at[i], 2 * math.pi * j / cols))) for t in times for i in range(rows) for j in range(cols)], schema.FIELD)


def values(df):
    return {(r["time"], r["lat_idx"], r["lon_idx"]): r["v"] for r in df.collect()}


def test_legendre_functions_are_the_known_ones():
    th = np.linspace(0.1, 3.0, 7)
    p, x, s = spectral.legendre(th, 4), np.cos(th), np.sin(th)
    assert np.allclose(p[0, 0], math.sqrt(1 / 2)) and np.allclose(p[0, 2], math.sqrt(5 / 8) * (3 * x * x - 1))
    assert np.allclose(p[1, 1], math.sqrt(3 / 4) * s) and np.allclose(p[1, 3], math.sqrt(21 / 32) * s * (5 * x * x - 1))
    assert np.allclose(p[3, 4], math.sqrt(315 / 32) * s**3 * x)


#: harmonics (m, l) with l + m even, in closed form
SHAPES = {(0, 0): lambda x, s: 1, (0, 2): lambda x, s: 3 * x * x - 1, (1, 3): lambda x, s: s * (5 * x * x - 1), (2, 4): lambda x, s: s**2 * (7 * x * x - 1), (3, 5): lambda x, s: s**3 * (9 * x * x - 1), (5, 5): lambda x, s: s**5, (4, 6): lambda x, s: s**4 * (11 * x * x - 1), (6, 8): lambda x, s: s**6 * (15 * x * x - 1), (7, 9): lambda x, s: s**7 * (17 * x * x - 1)}


@pytest.mark.parametrize("truncation", [4, 5, 8])
def test_harmonics_stay_or_go(spark, truncation):
    wave = lambda keep: lambda t, th, lon: sum((1 + t + m) * f(math.cos(th), math.sin(th)) * math.cos(m * lon - l) for (m, l), f in SHAPES.items() if keep(l))
    out = values(spectral.truncate(grid(spark, wave(lambda l: True), times=(0, 3)), truncation, n_lat=14, n_lon=24))
    want = values(grid(spark, wave(lambda l: l <= truncation), times=(0, 3)))
    assert out.keys() == want.keys() and all(abs(out[k] - want[k]) < 1e-9 for k in want)


def test_truncation_twice_is_once_and_missing_cells_are_zero(spark):
    rough = grid(spark, lambda t, th, lon: math.sin(40 * th * th + 3 * lon) + (lon > 2))
    once = spectral.truncate(rough, 6, n_lat=14, n_lon=24)
    a, b = values(once), values(spectral.truncate(once, 6, n_lat=14, n_lon=24))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
    gone = "lat_idx = 3 AND lon_idx > 20"
    zero = values(spectral.truncate(rough.selectExpr("time", "lat_idx", "lon_idx", f"if({gone}, 0.0, v) AS v"), 6, n_lat=14, n_lon=24))
    null = values(spectral.truncate(rough.selectExpr("time", "lat_idx", "lon_idx", f"if({gone}, null, v) AS v"), 6, n_lat=14, n_lon=24))
    less = values(spectral.truncate(rough.filter(f"NOT ({gone})"), 6, n_lat=14, n_lon=24))
    assert len(less) == len(zero) - 3 and all(abs(less[k] - zero[k]) < 1e-9 for k in less) and all(abs(null[k] - zero[k]) < 1e-9 for k in zero)


def test_what_a_grid_does_not_resolve(spark):
    df = grid(spark, lambda t, th, lon: 1)
    for t, n_lat, n_lon in ((-1, 14, 24), (12, 14, 24), (9, 4, 24)):
        with pytest.raises(ValueError):
            spectral.truncate(df, t, n_lat=n_lat, n_lon=n_lon)
    assert spectral.truncate(df.limit(0), 6, n_lat=14, n_lon=24).collect() == []
