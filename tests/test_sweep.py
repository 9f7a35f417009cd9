"""The comparison of methods on the polar raster against masks made one at a time, and its steps against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_waves import CONFIG, wave
from wavefold import schema
from wavefold.config import Config
from wavefold.operators import compare, frames, stencil
from wavefold.plans.identify import amplitude_mask, identify, method_sweep, packet_mask
from wavefold.sources.staging import save


@pytest.fixture(scope="module")
def two_steps(spark):
    return save(spark.createDataFrame(wave(0) + wave(1, 0.8), schema.FIELD))


def test_nearest_cells(spark):
    """Uneven axes, one of them falling; the lower of two as near; none beyond the ends."""
    lats, lons = [80.0, 60.0, 50.0, 20.0], [0.0, 10.0, 90.0]
    field = spark.createDataFrame([(0, i, j, lat, lon, 1.0) for i, lat in enumerate(lats) for j, lon in enumerate(lons)], schema.FIELD)
    pixels = [(0, c, lat, lon) for c, (lat, lon) in enumerate([(20.0, 0.0), (35.0, 5.0), (35.1, 5.1), (55.0, 50.0), (80.0, 90.0), (80.1, 0.0), (30.0, 91.0), (19.9, 0.0)])]
    grid = spark.createDataFrame([(*p[:2], float(p[2]), float(p[3])) for p in pixels], "row int, col int, lat double, lon double")
    got = {r["col"]: (lats[r["lat_idx"]], lons[r["lon_idx"]]) for r in compare.nearest_cells(grid, field).collect()}
    assert got == {0: (20.0, 0.0), 1: (20.0, 0.0), 2: (50.0, 10.0), 3: (50.0, 10.0), 4: (80.0, 90.0)}
    cells = save(compare.nearest_cells(grid, field))
    strong = spark.createDataFrame([(7, 3, 0)], "time int, lat_idx int, lon_idx int")
    assert {tuple(r) for r in compare.regrid(strong, cells).collect()} == {(7, 0, 0), (7, 0, 1)}
    assert compare.nearest_cells(grid, field.filter("false")).collect() == []


def test_agreement_against_sets(spark):
    """Nested masks as levels and masks of their own, time steps without either, thresholds without a pixel."""
    rng = np.random.default_rng(0)
    levels, own = [10.0, 20.0, 30.0, 99.0], [0.5, 0.7]
    pixels = [(t, int(r), int(c), float(v)) for t in (0, 1, 3) for r, c, v in zip(rng.integers(0, 6, 40), rng.integers(0, 6, 40), rng.uniform(0, 50, 40), strict=True)]
    masks = [("own", t, s, int(r), int(c)) for t in own for s in (0, 1) for r, c in rng.integers(0, 6, (12, 2))]
    reference = [(s, int(r), int(c)) for s in (0, 2) for r, c in rng.integers(0, 6, (15, 2))]
    hits = compare.levelled(spark.createDataFrame(pixels, "time int, row int, col int, level double"), "level", levels).unionByName(spark.createDataFrame(masks, "method string, threshold double, time int, row int, col int"))
    thresholds = spark.createDataFrame([("level", t, True) for t in levels] + [("own", t, False) for t in own], "method string, threshold double, suffix boolean")
    out = compare.agreement(hits, spark.createDataFrame(reference, "time int, row int, col int"), thresholds, spark.range(5).select(F.col("id").cast("int").alias("time")), 36)
    got = {(r["method"], r["threshold"], r["time"]): r for r in out.collect()}
    assert len(got) == 5 * 6
    for (method, threshold, time), r in got.items():
        a = {(x, y) for t, x, y, v in pixels if t == time and v >= threshold} if method == "level" else {(x, y) for _, t, s, x, y in masks if s == time and t == threshold}
        b = {(x, y) for t, x, y in reference if t == time}
        assert (r["shared"], r["joint"], r["agree"]) == (len(a & b), len(a | b), bool(a) == bool(b))
        assert r["iou"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert (r["only_a"], r["only_b"]) == pytest.approx((len(a - b) / 36, len(b - a) / 36))


def test_agreement_by_cells_of_the_field(spark):
    """A mask of the field's cells counts as its pixels do: cells of several pixels and of none, pixels of no cell, rows that come twice."""
    rng = np.random.default_rng(3)
    cells = spark.createDataFrame([(r, c, r // 3, c // 2) for r in range(6) for c in range(5)], "row int, col int, lat_idx int, lon_idx int")
    mask = spark.createDataFrame([(int(t), int(i), int(j)) for t, i, j in rng.integers(0, 4, (12, 3))] * 2, "time int, lat_idx int, lon_idx int")
    pixels = [("m", float(x), int(t), int(r), int(c)) for x, t, r, c in rng.integers(0, 7, (60, 4))]
    hits = spark.createDataFrame(pixels, "method string, threshold double, time int, row int, col int")
    thresholds = spark.createDataFrame([("m", float(t), s) for t, s in ((0, True), (3, True), (6, True))], "method string, threshold double, suffix boolean")
    times = spark.range(6).select(F.col("id").cast("int").alias("time"))
    want = compare.agreement(hits, compare.regrid(mask, cells), thresholds, times, 36)
    got = compare.agreement(hits, mask, thresholds, times, 36, cells)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.agg(F.sum("shared")).first()[0] > 5


def test_sweep_equals_masks_made_one_at_a_time(spark, two_steps):
    prunings, amplitudes = [0.0, 0.02, 0.03, 9.0], [12.0, 20.0, 25.0]
    c = Config(**vars(CONFIG) | {"max_edge_weight": 10.0})
    grid = save(compare.in_band(compare.pixel_grid(spark, 64, frames.HALF_WIDTH)))
    seen = save(compare.regrid(compare.envelope_mask(stencil.envelope(two_steps), 8.0), compare.nearest_cells(grid, two_steps)))
    assert seen.count() > 50
    runs = save(method_sweep(two_steps, c, amplitudes=amplitudes, prunings=prunings, n_lon=144, pixels=64, reference=8.0))
    got = {(r["method"], r["threshold"], r["time"]): r for r in runs.collect()}
    assert len(got) == 2 * 7
    times, found = two_steps.select("time").distinct(), []
    for p in prunings:
        labels = identify(two_steps, Config(**vars(c) | {"edge_pruning_threshold": p}), n_lon=144, pixels=64)["labels"]
        found += [(("edge_pruning", p, r["time"]), r) for r in compare.iou(packet_mask(labels, grid), seen, times).collect()]
    for a in amplitudes:
        found += [(("node_amplitude", a, r["time"]), r) for r in compare.iou(amplitude_mask(two_steps, c, grid, a, n_lon=144, pixels=64), seen, times).collect()]
    for key, r in found:
        assert (got[key]["shared"], got[key]["joint"], got[key]["agree"]) == (r["shared"], r["joint"], r["agree"])
    # thresholds tell masks apart, and the last leaves none
    assert len({tuple(got["edge_pruning", p, t]["joint"] for t in (0, 1)) for p in prunings}) > 1 and got["edge_pruning", 9.0, 0]["shared"] == 0
    means = compare.sweep(runs).collect()
    assert len(means) == 7 and all(r["n"] == 2 and 0 <= r["mean_only_a"] <= 1 for r in means)


def plain_touched(ring, n, all_touched):
    """Pixels of unit size whose square (or centre) no line along an edge of a convex ring leaves outside."""
    out = set()
    for r in range(n):
        for c in range(n):
            x, y = c + 0.5, n - 1 - r + 0.5
            sides = [((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1), (abs(x2 - x1) + abs(y2 - y1)) / 2) for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], *ring[:1]], strict=True)]
            box = max(p[0] for p in ring) >= c and min(p[0] for p in ring) <= c + 1 and max(p[1] for p in ring) >= y - 0.5 and min(p[1] for p in ring) <= y + 0.5
            if box and all(s + (reach if all_touched else 0) >= 0 for s, reach in sides):
                out.add((r, c))
    return out


def test_pixels_of_hulls(spark):
    """Random hulls, some of them partly or wholly beyond the raster, slivers and upright edges."""
    rng = np.random.default_rng(3)
    n, rings = 12, {}
    for i in range(60):
        points = rng.uniform(-3, n + 3, (int(rng.integers(3, 9)), 2)) if i % 3 else rng.uniform(2, 9, 2) + rng.uniform(0, 1.5, (5, 2)) * [1, 0.1]
        rings[i] = frames.convex_hull([tuple(map(float, p)) for p in points])
    rings[60] = [(2.25, 2.25), (6.75, 2.25), (6.75, 5.5), (2.25, 5.5)]
    df = spark.createDataFrame([(i, "x", [{"x": x - n / 2, "y": y - n / 2} for x, y in r]) for i, r in rings.items()], "i int, name string, ring array<struct<x:double,y:double>>")
    for all_touched in (True, False):
        got = {}
        for r in frames.touched(df.repartition(3), n, n / 2, all_touched=all_touched).collect():
            got.setdefault(r["i"], set()).add((r["row"], r["col"]))
        assert got == {i: p for i, r in rings.items() if (p := plain_touched(r, n, all_touched))}
    assert frames.touched(df.filter("false"), n, n / 2).collect() == []
