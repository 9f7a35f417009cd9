"""The clipped surface in closed form, its ways, regions and clusters against plain versions."""

import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavefold import schema
from wavefold.operators import surface
from wavefold.sources.staging import save


def field(spark, f, rows=6, cols=8, times=(0,)):
    return spark.createDataFrame([(t, i, j, 20.0 + 10 * i, 360.0 * j / cols, float(f(t, i, j))) for t in times for i in range(rows) for j in range(cols)], schema.FIELD)


def test_triangles_close_at_the_seam(spark):
    mesh = surface.triangles(field(spark, lambda t, i, j: i), 8).collect()
    assert len(mesh) == 2 * 5 * 8 and len({frozenset((r["a"]["id"], r["b"]["id"], r["c"]["id"])) for r in mesh}) == 80
    assert surface.edges(surface.triangles(field(spark, lambda t, i, j: i), 8)).count() == 6 * 8 + 5 * 8 * 2
    # a missing point takes its cells with it
    assert surface.triangles(field(spark, lambda t, i, j: i).filter("NOT (lat_idx = 2 AND lon_idx = 0)"), 8).count() == 2 * (40 - 4)


def flat_area(t):
    (x1, y1), (x2, y2), (x3, y3) = ((p["lon"], p["lat"]) for p in (t["a"], t["b"], t["c"]))
    x2, x3 = (x1 + (x - x1 + 180) % 360 - 180 for x in (x2, x3))
    return abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2


@pytest.mark.parametrize("value", [22.5, 35.0, 40.0, 69.9, 70.0, 80.0, 10.0])
def test_clip_of_a_linear_field(spark, value):
    """v is the latitude: what is left is all north of the value, and its edge lies on it."""
    mesh = surface.triangles(field(spark, lambda t, i, j: 20 + 10 * i), 8)
    out = surface.clip(mesh, lambda p: p["v"], value).collect()
    assert sum(map(flat_area, out)) == pytest.approx(360 * max(0.0, 70 - max(value, 20.0)))
    points = {(p["id"], p["lat"], p["lon"], p["v"]) for r in out for p in (r["a"], r["b"], r["c"])}
    assert len({p[0] for p in points}) == len(points)  # a cut is one point for both its triangles
    assert all(p[1] == pytest.approx(p[3]) and p[1] >= value - 1e-9 for p in points)
    cut = [p for p in points if "|" in p[0]]
    assert all(p[1] == pytest.approx(value) for p in cut) and len(cut) == (16 if value in (22.5, 35.0, 69.9) else 0)
    below = surface.clip(mesh, lambda p: -p["v"], -value).collect()
    assert sum(map(flat_area, out)) + sum(map(flat_area, below)) == pytest.approx(360 * 50)


def test_clip_is_little_code(spark):
    """Which of two vertices comes first is decided once for each cut, not in each part of it, so that the JVM compiles it."""
    tri = surface.triangles(field(spark, lambda t, i, j: float(i - j), 3, 6), 6)
    plan = surface.clip(tri, lambda p: p["v"], 0.5)._jdf.queryExecution().optimizedPlan()
    from_ids = re.findall(r"CASE WHEN \([pqr]#\d+\.id < ", plan.toString())
    assert 0 < len(from_ids) <= 4


def test_clips_of_clips(spark):
    """A band of latitude and a column's own value, in either order, leave the same area."""
    mesh = surface.triangles(field(spark, lambda t, i, j: 3 * i + j % 4), 8).withColumn("least", F.lit(5.5))
    north = lambda s: surface.clip(s, lambda p: p["lat"], 33.0)
    strong = lambda s: surface.clip(s, lambda p: p["v"], F.col("least"))
    one, other = strong(north(mesh)).collect(), north(strong(mesh)).collect()
    assert sum(map(flat_area, one)) == pytest.approx(sum(map(flat_area, other))) and sum(map(flat_area, one)) > 0
    assert surface.clip(mesh, lambda p: p["v"], 99.0).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_parts(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    a, b = rng.integers(0, n, (2, int(rng.integers(0, 70))))
    want = list(range(n))
    for _ in range(n):
        for x, y in zip(a, b, strict=True):
            want[x] = want[y] = min(want[x], want[y])
    assert surface.parts(n, a, b).tolist() == want
    # a long chain in falling order settles too
    chain = np.arange(500)
    assert set(surface.parts(501, chain[::-1] + 1, chain[::-1])) == {0}


def chord(p, q):
    at = lambda p: np.array([math.cos(math.radians(p[0])) * math.cos(math.radians(p[1])), math.cos(math.radians(p[0])) * math.sin(math.radians(p[1])), math.sin(math.radians(p[0]))])
    return 6371.0 * float(np.linalg.norm(at(p) - at(q)))


def plain_ways(rows, targets):
    """{pair: (km, least |v| on the way)} by relaxing all edges until nothing changes."""
    place = {p["id"]: (p["lat"], p["lon"], p["v"]) for r in rows for p in (r["a"], r["b"], r["c"])}
    sides = {tuple(sorted(e)) for r in rows for e in itertools.combinations([r[x]["id"] for x in "abc"], 2)}
    out = {}
    for s in targets:
        best = {s: (0.0, abs(place[s][2]))}
        changed = True
        while changed:
            changed = False
            for a, b in [*sides, *((b, a) for a, b in sides)]:
                if a in best and (d := best[a][0] + chord(place[a], place[b])) < best.get(b, (math.inf,))[0] - 1e-9:
                    best[b], changed = (d, min(best[a][1], abs(place[b][2]))), True
        out |= {(s, t): best[t] for t in targets if t in best and t != s}
    return out


def test_ways_and_clusters(spark):
    """Several frames and both signs: shortest ways, clusters by length and descent, regions named by their least cell."""
    rng = random.Random(4)
    bumps = {(t, s): [(rng.uniform(0, 7), rng.uniform(0, 15), rng.uniform(8, 20)) for _ in range(4)] for t in (0, 1) for s in (1, -1)}

    def v(t, i, j):
        return sum(s * h * math.exp(-((i - y) ** 2 + min(abs(j - x), 16 - abs(j - x)) ** 2) / 3) for s in (1, -1) for y, x, h in bumps[t, s])

    df = save(field(spark, v, 8, 16, (0, 1)))
    signed = surface.triangles(df, 16).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    strong = save(surface.clip(signed, lambda p: p["v"] * F.col("sign"), 2.0))
    rows, extrema = {}, {}
    for r in strong.collect():
        rows.setdefault((r["time"], r["sign"]), []).append(r)
    for key, some in rows.items():
        own = sorted({p["id"] for r in some for p in (r["a"], r["b"], r["c"]) if "|" not in p["id"]}, key=int)
        extrema[key] = sorted(rng.sample(own, min(5, len(own))), key=int)
    points = spark.createDataFrame([(t, s, int(c)) for (t, s), some in extrema.items() for c in some] + [(0, 1, 9999)], "time int, sign int, cell long")
    eps, scale = 4500.0, 1500.0
    got = {(r["time"], r["cell"]): (r["region"], r["cluster"]) for r in surface.cluster(strong, points, eps_km=eps, scale_km=scale).collect()}
    assert len(got) == sum(map(len, extrema.values()))
    joined = 0
    for (t, s), some in rows.items():
        ways = plain_ways(some, extrema[t, s])
        g = surface.Graph(pd.DataFrame([{f"{x}_{c}": r[x][c] for x in "abc" for c in ("id", "lat", "lon", "v")} for r in some]))
        at = {n: i for i, n in enumerate(g.names)}
        for a in extrema[t, s]:
            found = g.ways(at[a], {at[x] for x in extrema[t, s]}, math.inf)
            assert {x: found[at[x]] for x in extrema[t, s] if at[x] in found} == {b: pytest.approx(w) for (x, b), w in ways.items() if x == a}
            assert len(g.ways(at[a], {at[x] for x in extrema[t, s]}, 1.0)) == 0
        value = {p["id"]: p["v"] for r in some for p in (r["a"], r["b"], r["c"])}
        name = {c: c for c in extrema[t, s]}
        for _ in name:
            for (a, b), (km, low) in ways.items():
                ref = min(abs(value[a]), abs(value[b]))
                if km + max(0.0, (ref - low) / ref) * scale <= eps:
                    name[a] = name[b] = min(name[a], name[b], key=int)
                    joined += 1
        sides = {frozenset(e) for r in some for e in itertools.combinations([r[x]["id"] for x in "abc"], 2)}
        region = {n: n for e in sides for n in e}
        for _ in range(len(region)):
            before = dict(region)
            for a, b in map(tuple, sides):
                region[a] = region[b] = min(region[a], region[b], key=lambda n: (not n.isdigit(), int(n) if n.isdigit() else 0, n))
            if region == before:
                break
        for c in extrema[t, s]:
            assert got[t, int(c)] == (int(region[c]), int(name[c]))
    assert joined > 0


def test_regions_around_nodes(spark):
    """Two crests of one packet, one of another, cut points with them; a node on no triangle has none."""
    df = field(spark, lambda t, i, j: {1: 10, 5: 9}.get(j, 0) if 1 <= i <= 3 else 0, 6, 8)
    on = spark.createDataFrame([(0, 1, 1, 7, 2 * 8 + 1), (0, 1, 1, 8, 2 * 8 + 5), (0, 2, 1, 9, 1 * 8 + 1), (0, 3, 1, 3, 0)], "time int, rwp_id long, sign int, node long, cell long")
    mesh = surface.triangles(df, 8).join(on.select("time", "rwp_id", "sign").distinct(), "time")
    out = {}
    for r in surface.around(surface.clip(mesh, lambda p: p["v"] * F.col("sign"), 5.0), on).collect():
        out.setdefault((r["rwp_id"], r["node"]), {})[r["id"]] = (r["lat"], r["lon"], r["v"])
    assert set(out) == {(1, 7), (1, 8), (2, 9)} and out[1, 7] == out[2, 9]
    for key, j in (((1, 7), 1), ((1, 8), 5)):
        grid = {n for n in out[key] if "|" not in n}
        assert grid == {str(8 * i + j) for i in (1, 2, 3)}
        # six neighbours along the edges of the mesh for each point, shared ones once
        assert all(v == pytest.approx(5.0) for n, (_, _, v) in out[key].items() if n not in grid) and len(out[key]) == 3 + 14
