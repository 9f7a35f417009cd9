"""Operators on made-up fields and rasters whose results are known."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold import queries, schema
from wavefold.config import Config
from wavefold.functions import geo
from wavefold.operators import association, compare, features, frames, stencil, tracking
from wavefold.plans.catalogue import Catalogue, histogram, path_edges
from wavefold.plans.identify import amplitude_mask, extract_features, extrema_clusters, identify, packet_mask, track, tracks
from wavefold.sources import catalogue_io
from wavefold.sources.staging import save


def bump(x, c, s):
    return math.exp(-((x - c) ** 2) / (2 * s * s))


def wave(t=0, scale=1.0):
    k, s = math.radians(4), 5 * t
    return [(t, i, j, 20 + 2.5 * i, 2.5 * j, scale * 30 * bump(2.5 * j, 202.5 + s, 90) * bump(20 + 2.5 * i, 50, 10) * math.sin(k * (2.5 * j - s))) for i in range(25) for j in range(144)]


@pytest.fixture(scope="module")
def two_steps(spark):
    return save(spark.createDataFrame(wave(0) + wave(1), schema.FIELD))


CONFIG = Config.default(min_latitude=20.0, max_latitude=80.1, node_pruning_threshold=15.0)


def test_extrema(spark):
    field = spark.createDataFrame([(0, i, j, 20 + 2.5 * i, 2.5 * j, 30 * math.exp(-((2.5 * j - 180) ** 2 + (2.5 * i - 30) ** 2) / 200)) for i in range(25) for j in range(144)], schema.FIELD)
    [top] = stencil.local_maxima(field, 10.0).collect()
    assert (top["lat"], top["lon_idx"]) == (50, 72) and top["lon"] == pytest.approx(360 * 72 / 143)
    assert stencil.local_minima(field, 10.0).collect() == []
    flat = field.withColumn("v", F.lit(0.0))
    assert stencil.local_maxima(flat, 10.0).collect() == [] and stencil.zero_contour(flat).collect() == []


def test_extrema_wrap_around(spark):
    v = {(1, 0): 5.0, (1, 3): 4.0}
    field = spark.createDataFrame([(0, i, j, float(i), float(j), v.get((i, j), 0.0)) for i in range(3) for j in range(4)], schema.FIELD)
    assert [(r["lat_idx"], r["lon_idx"]) for r in stencil.local_maxima(field, 1.0).collect()] == [(1, 0)]


def test_envelope_of_a_modulated_wave(spark):
    x = [2 * math.pi * j / 360 for j in range(360)]
    field = spark.createDataFrame([(0, 0, j, 50.0, float(j), (10 + 5 * math.cos(a)) * math.cos(7 * a)) for j, a in enumerate(x)], schema.FIELD)
    for r in stencil.envelope(field, n_lon=360).collect():
        assert r["envelope"] == pytest.approx(10 + 5 * math.cos(x[r["lon_idx"]]), rel=1e-6)


def test_identification_finds_a_packet(two_steps):
    out = {k: save(v) for k, v in identify(two_steps, CONFIG, n_lon=144).items()}
    nodes = out["nodes"].collect()
    assert {r["time"] for r in nodes} == {0, 1} and len([r for r in nodes if r["time"] == 0]) >= 2
    assert out["edges"].filter("time = 0").count() == len([r for r in nodes if r["time"] == 0]) - out["rwps"].filter("time = 0").count()
    rwps = out["rwps"].collect()
    assert all(r["geometry_wkb"][:1] == b"\x01" and 20 <= r["weighted_lat"] <= 80 for r in rwps)
    cells = out["labels"].join(out["energies"], ["time", "row", "col"]).withColumn("time", F.col("time").cast("long"))
    places = out["rwps"].select("time", "rwp_id", F.col("weighted_lon").alias("lon"), F.col("weighted_lat").alias("lat"))
    best = tracking.prune(tracking.edges(cells, places)).agg(F.max("weight")).first()[0]
    assert 0.3 < best < 1
    assert out["samples"].count() > 0


def test_identification_inside_a_band(two_steps):
    """Bounds between the grid's rows: extrema and footprints lie inside, cut where the bound is."""
    narrow = Config(**vars(CONFIG) | {"min_latitude": 33.3, "max_latitude": 61.9})
    high, low, members = extrema_clusters(two_steps, narrow, 144)
    assert high.count() and low.count() and members.filter("lat < 33.3 OR lat > 61.9").count() == 0
    out = {k: save(v) for k, v in identify(two_steps, narrow, n_lon=144).items()}
    assert out["nodes"].count() and out["samples"].filter("lat < 33.3 OR lat > 61.9").count() == 0
    assert out["labels"].count() < identify(two_steps, CONFIG, n_lon=144)["labels"].count()


def test_flat_fields_have_no_packets(two_steps):
    out = identify(two_steps.withColumn("v", F.lit(0.0)), CONFIG, n_lon=144)
    assert all(out[t].count() == 0 for t in ("nodes", "edges", "rwps", "samples", "labels", "energies"))


def test_southern_hemisphere(spark):
    field = spark.createDataFrame([(t, i, j, -80 + 2.5 * i, lon, wave()[(24 - i) * 144 + j][5]) for t, i, j, _, lon, _ in wave()], schema.FIELD)
    out = identify(field, Config.default(min_latitude=-80.1, max_latitude=-20.0, node_pruning_threshold=15.0, hemisphere="south"), n_lon=144)
    assert out["rwps"].count() >= 1


def cells(spark, label, energy):
    rows = [(t, i, j, label[t][i][j], float(energy[t][i][j])) for t in range(len(label)) for i in range(len(label[t])) for j in range(len(label[t][i]))]
    return spark.createDataFrame(rows, "time long, row int, col int, rwp_id long, energy double")


def test_overlap(spark):
    one = cells(spark, [[[0, 1, 1], [2, 2, 0]]], [[[0, 3, 1], [5, 5, 0]]])
    assert {(r["rwp_id"], r["energy"]) for r in tracking.feature_energies(one).collect()} == {(1, 4), (2, 10)}
    two = cells(spark, [[[1, 1, 0, 2, 2]], [[0, 1, 1, 0, 2]]], [[[4, 4, 0, 9, 9]], [[0, 1, 1, 0, 1]]])
    assert {(r["feat_from"], r["feat_to"], r["overlap"]) for r in tracking.overlaps(two).collect()} == {(1, 1, 2), (2, 2, 3)}
    same = cells(spark, [[[1, 1]], [[1, 1]]], [[[4, 5]], [[4, 5]]])
    places = spark.createDataFrame([(0, 1, 0.0, 50.0), (1, 1, 10.0, 50.0)], "time long, rwp_id long, lon double, lat double")
    [e] = tracking.edges(same, places).collect()
    assert e["weight"] == 1 and e["src"] == "0:1" and e["dst"] == "1:1"


TRACK = "src string, dst string, time_from long, feat_from long, time_to long, feat_to long, weight double, distance double"


def edge(t, a, b, w, d=700.0):
    return (f"{t}:{a}", f"{t + 1}:{b}", t, a, t + 1, b, w, d)


def test_pruning(spark):
    e = spark.createDataFrame([edge(0, 1, 1, 0.3), edge(0, 2, 2, 0.5, 9000.0), edge(0, 3, 3, 0.29)], TRACK)
    assert {r["src"] for r in tracking.prune(e, 8000, 0.3).collect()} == {"0:1"}
    assert tracking.prune(e, None, None).count() == 3


@pytest.mark.parametrize(("steps", "block"), [(6, 256), (23, 3), (40, 2)])
def test_track_paths_against_brute_force(spark, steps, block):
    """In one block of time, and in many, settled over several levels."""
    rng = random.Random(steps)
    rows = [edge(t, a, b, rng.randrange(1, 1024) / 1024) for t in range(steps) if t != 11 for a in range(5) for b in range(5) if rng.random() < 0.4]
    got = {}
    for r in tracking.track_paths(spark.createDataFrame(rows, TRACK), save, block=block).collect():
        got.setdefault(r["track_id"], {})[r["pos"]] = r["key"]
    got = [[p[i] for i in range(len(p))] for _, p in sorted(got.items())]
    best = {}
    for s, d, *_, w, _ in sorted(rows, key=lambda r: r[2]):
        total = best.get(s, (0, None))[0] + w
        if d not in best or total > best[d][0]:
            best[d] = (total, s)
    paths = []
    for k in {r[1] for r in rows} - {r[0] for r in rows}:
        p = [k]
        while p[-1] in best:
            p.append(best[p[-1]][1])
        paths.append((-best[k][0], k, p[::-1]))
    want, used = [], set()
    for _, _, p in sorted(paths):
        if used.isdisjoint(p):
            want.append(p)
            used.update(p)
    assert got == want


def test_masks(spark):
    m = lambda rows: spark.createDataFrame([(0, r, c) for r, c in rows], "time int, row int, col int")
    times = spark.createDataFrame([(0,)], "time int")
    square = [(r, c) for r in range(2) for c in range(2)]
    one = lambda a, b: compare.iou(m(a), m(b), times).first()["iou"]
    assert (one(square, square), one(square, [(3, 3)]), one([], [])) == (1, 0, 1)
    assert one(square, [(0, 0)]) == 0.25
    d = compare.disagreement(m(square), m([(0, 0), (3, 3)]), 16).first()
    assert (d["only_a"], d["only_b"]) == (3 / 16, 1 / 16)


def test_running_mean(spark):
    field = spark.createDataFrame([(t, 0, 0, 50.0, 0.0, 24.0 if t == 24 else 0.0) for t in range(48)], schema.FIELD)
    out = {r["time"]: r["v"] for r in stencil.running_mean(field, 24).collect()}
    assert out[24] == 1 and out[0] == 0 and len(out) == 48
    assert {r["time"]: r["v"] for r in stencil.running_mean(field, 1).collect()}[24] == 24


def test_hulls():
    box = lambda x: [(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0)]
    assert frames.iou(box(0.0), box(5.0)) == pytest.approx(1 / 3)
    assert frames.convex_hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert frames.area(frames.convex_hull([(5.0, 5.0)])) == 20_000.0**2


def test_floods_share_out_regions(spark):
    cells = [(0, 0, r * 10 + k, {(0, 0): 7, (0, 6): 3}.get((r, k))) for r in range(2) for k in range(7)] + [(0, 99, 99, 5)]
    df = spark.createDataFrame(cells, "time int, region long, cell long, seed long")
    got = {r["cell"]: r["seed"] for r in frames.partition(df, 10).collect()}
    # the cell between goes to the smaller seed, which begins first
    assert got == {r * 10 + k: 7 if k < 3 else 3 for r in range(2) for k in range(7)} | {99: 5}


def test_rasters_take_what_hulls_touch(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0.4, 0.4), (2.2, 0.4), (2.2, 1.2))]
    hulls = spark.createDataFrame([(0, 1, 0, ring)], "time int, rwp_id long, node long, ring array<struct<x:double,y:double>>")
    pixels = lambda **o: {(r["row"], r["col"]) for r in frames.rasterise(hulls, 4, 2.0 + 1e-9, **o).collect()}
    # pixels of a unit: columns 2 and 3 hold x from 0 to 2, rows 1 and 0 hold y from 0 to 2
    assert pixels() == {(1, 2), (1, 3), (0, 3)} and pixels(all_touched=False) == {(1, 3)}
    nodes = spark.createDataFrame([(0, 1, 0, 0.5, 0.5, 3.0)], "time int, rwp_id long, pos long, x double, y double, scalar double")
    disk = lambda **o: frames.energy_disks(nodes, 4, 2.0, radius_m=0.6, **o)
    assert {(r["row"], r["col"], r["energy"]) for r in disk().collect()} == {(1, 2, 9.0), (0, 2, 9.0), (2, 2, 9.0), (1, 1, 9.0), (1, 3, 9.0)}
    assert disk(all_touched=False).count() == 1
    # of two disks on a pixel that of the later packet counts, and of a packet's that of the later node, however weak
    nodes = spark.createDataFrame([(0, 1, 0, 0.5, 0.5, 9.0), (0, 1, 1, 0.5, 0.5, 2.0), (1, 1, 3, 0.5, 0.5, 9.0), (1, 2, 0, 0.5, 0.5, 4.0)], nodes.schema)
    assert {(r["time"], r["energy"]) for r in disk().collect()} == {(0, 4.0), (1, 16.0)}


def test_pixel_grid_and_masks(spark, two_steps):
    grid = save(compare.pixel_grid(spark, 64, 12713600.098850505))
    assert grid.count() == 64 * 64 and 0 < compare.in_band(grid).count() < 64 * 64
    found = identify(two_steps, CONFIG, n_lon=144, pixels=64)
    packets, strong = packet_mask(found["labels"], grid), amplitude_mask(two_steps, CONFIG, grid, 15.0, n_lon=144, pixels=64)
    assert 0 < strong.count() and 0 < packets.count() <= found["labels"].count()
    assert amplitude_mask(two_steps, CONFIG, grid, 99.0, n_lon=144, pixels=64).count() == 0
    wide = identify(two_steps, Config.default(**vars(CONFIG) | {"hull_method": "convex"}), n_lon=144, pixels=64)
    # a packet's one hull covers those of its nodes
    assert found["labels"].join(wide["labels"], ["time", "row", "col"], "left_anti").count() == 0 and wide["labels"].count() > found["labels"].count()
    # the concave hull lies in the convex one, and its pixels in that one's
    hollow = identify(two_steps, Config.default(**vars(CONFIG) | {"hull_method": "concave"}), n_lon=144, pixels=64)
    assert hollow["labels"].join(wide["labels"], ["time", "row", "col"], "left_anti").count() == 0 and hollow["labels"].count() > 0
    of = lambda x: {(r["time"], r["rwp_id"]): r for r in x["shapes"].collect()}
    whole, inner, own = of(wide), of(hollow), of(found)
    assert whole.keys() == inner.keys() == own.keys() and whole
    assert all(inner[k]["area"] < whole[k]["area"] and own[k]["area"] < whole[k]["area"] and inner[k]["polygons"] == 1 and inner[k]["holes"] == 0 for k in whole)
    with pytest.raises(ValueError):
        identify(two_steps, Config.default(hull_method="round"), n_lon=144)


def test_tracking_of_identified_packets_and_features(two_steps):
    found = {k: save(v) for k, v in identify(two_steps, CONFIG, n_lon=144).items()}
    nodes, edges = track(found)
    assert edges.count() >= 1 and nodes.count() == found["labels"].select("time", "rwp_id").distinct().count()
    assert tracks(edges, CONFIG).count() >= 2
    assert tracks(edges, CONFIG, max_km=0.0).count() == 0 and track(found, number_steps=1)[1].count() == 0
    own = save(extract_features(two_steps, CONFIG, threshold=15.0, fraction=3.0, n_lon=144))
    rows = own.collect()
    assert {r["node_type"] for r in rows} == {"max", "min"} and all(len(r["ring"]) >= 3 for r in rows)
    steps = features.track(own, save, most_shift=20.0)
    assert steps.groupBy("track_id").count().filter("count = 2").count() >= 2


def test_packet_statistics_and_anomalies(spark):
    nodes = [(0, 1, 1, "max", 0.0, 50.0, 5.0, 0, 0), (0, 1, -2, "min", 30.0, 52.0, -5.0, 1, 0), (0, 2, 3, "max", 20.0, 60.0, 5.0, 2, 0), (0, 3, 4, "max", 90.0, 50.0, 5.0, 3, 0), (1, 1, 5, "max", 0.0, 20.0, 5.0, 4, 0), (1, 2, 6, "max", 0.0, 50.0, 5.0, 5, 0)]
    df = spark.createDataFrame(nodes, schema.TABLES["nodes"])
    c = Catalogue({"nodes": df, "edges": path_edges(df)}, {})
    got = {r["time"]: r for r in c.path_statistics().collect()}
    assert got[0]["n_packets"] == 3 and got[0]["edges_per_packet"] == pytest.approx(1 / 3) and got[0]["extent_km"] == pytest.approx(got[0]["max_km"] / 3)
    assert got[1]["n_packets"] == 2 and got[1]["mean_km"] is None
    assert {(r["time"], r["single"], r["interleaved"]) for r in c.anomalies().collect()} == {(0, 2, 2), (1, 2, 0)}


def plain_interleaved(packets, gate):
    """{packets that meet another}, of {name: (first degree, degrees, low, high)}, by pairs."""
    bins = {k: {round(a + i) % 360 for i in range(int(n) + 1)} for k, (a, n, _, _) in packets.items()}
    return {k for k, p in packets.items() for j, q in packets.items() if j != k and bins[j] & bins[k] and max(p[2], q[2]) - min(p[3], q[3]) <= gate}


def test_anomalies_against_pairs(spark):
    rng = random.Random(8)
    packets = {(t, k): (rng.randrange(360), rng.randrange(30), low := rng.randrange(0, 180) / 2, low + rng.choice((0, 0.5, 7.5, 20))) for t in range(6) for k in range(4 + 3 * t)}
    rows = [(t, k, i, "max", float((a + x) % 360), y, 1.0, i, 0) for (t, k), (a, n, low, high) in packets.items() for i, (x, y) in enumerate(((0, low), (n, high)))]
    c = Catalogue({"nodes": save(spark.createDataFrame(rows, schema.TABLES["nodes"]))}, {})
    for gate in (15.0, 3.0, 0.0, -0.25):
        want = {t: len(plain_interleaved({k: p for k, p in packets.items() if k[0] == t}, gate)) for t in range(6)}
        assert {r["time"]: r["interleaved"] for r in c.anomalies(gate).collect()} == want


def test_anomalies_of_many_packets_in_one_place(spark):
    """20000 packets on a degree, which are 4e8 pairs, and two apart."""
    many = spark.range(20000).select(F.lit(0).cast("long").alias("time"), F.col("id").alias("rwp_id"), F.lit(0).cast("long").alias("node_id"), F.lit("max").alias("node_type"), F.lit(10.0).alias("lon"), (20 + F.pmod("id", F.lit(40))).cast("double").alias("lat"), F.lit(1.0).alias("scalar"), F.lit(0).cast("long").alias("cluster_id"), F.lit(0).cast("long").alias("region_id"))
    apart = spark.createDataFrame([(0, -1, 0, "max", 100.0, 50.0, 1.0, 0, 0), (0, -2, 0, "max", 100.0, 65.5, 1.0, 0, 0)], many.schema)
    c = Catalogue({"nodes": many.unionByName(apart)}, {})
    plan = c.anomalies()._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in c.anomalies().collect()] == [(0, 20002, 20000)]
    # the one join is with a row for each step and cell, grouped
    assert plan.count("Join") == 1


def test_nearest_as_the_c_library_has_it(spark):
    """Of mirrored places the nearer by a bit is found as C's functions round, which are Python's too."""

    def km(lat, lon):
        (a, b), (c, d) = ((x * (math.pi / 180), y * (math.pi / 180)) for x, y in ((lat, lon), (50.0, 20.0)))
        h = math.pow(math.sin((c - a) / 2), 2) + math.cos(a) * math.cos(c) * math.pow(math.sin((d - b) / 2), 2)
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    places = [(t, i, lon, lat) for t, (x, lat) in enumerate((x / 2, 20 + y / 2) for x in range(1, 40) for y in range(0, 121, 12)) for i, lon in enumerate((20 + x, 20 - x))]
    df = spark.createDataFrame([(t, i, x, y) for t, i, x, y in places], "time long, rwp_id long, weighted_lon double, weighted_lat double")
    got = df.select("time", "rwp_id", geo.exact_haversine_km("weighted_lat", "weighted_lon", 50, 20).alias("km")).collect()
    assert [(r["time"], r["rwp_id"], r["km"]) for r in sorted(got)] == [(t, i, km(y, x)) for t, i, x, y in places]
    plain = df.select("time", "rwp_id", geo.haversine_km("weighted_lat", "weighted_lon", 50, 20).alias("km")).collect()
    first = lambda rows: {t: min((r["km"], r["rwp_id"]) for r in rows if r["time"] == t)[1] for t in {r["time"] for r in rows}}
    a, b = first(got), first(plain)
    t = min(t for t in a if a[t] != b[t])
    c = Catalogue({"rwps": df}, {})
    assert c.packet_at(20, 50, t).first()["rwp_id"] == a[t]
    assert spark.range(1).select(geo.exact_haversine_km(F.lit(None).cast("double"), 0, 0, 0)).first()[0] is None


def test_many_rows_in_small_files_are_not_sent_through_the_driver(spark):
    """Features whose files are smaller than what is broadcast, and in memory far larger."""
    box = F.array(*(F.struct((F.lit(x) + F.pmod("id", F.lit(10))).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0))))
    rows = spark.range(20000).select(F.lit("r").alias("run"), F.floor(F.col("id") / 10).alias("time"), F.pmod("id", F.lit(10)).alias("id"), F.lit("max").alias("node_type"), F.lit(2.0).alias("lon"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("scalar"), box.alias("ring"), F.lit("strong").alias("strength"))
    found = save(rows)
    plan = features.pairs(found, 20.0)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) > 1


def test_groups_of_much_work_are_spread(spark):
    """Few bytes, which would be joined to one task, keep the session's number of tasks."""
    points = spark.createDataFrame([(0, k, 0, float(x), float(y)) for k in range(40) for x, y in ((0, 0), (1, 0), (0, 1))], "time int, rwp_id long, node long, x double, y double")
    found = frames.node_hulls(points)
    assert found.count() == 40 and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_small_regions_and_nodes_share_a_group(spark):
    """A frame's regions are flooded together without mixing, and a packet's nodes get their hulls together: few groups."""
    # two regions side by side, each with its seed at its far end
    df = spark.createDataFrame([(t, k // 4, k, {0: 9, 7: 2}.get(k)) for t in (0, 1) for k in range(8)], "time int, region long, cell long, seed long")
    floods = frames.partition(df, 20)
    assert {(r["time"], r["cell"]): r["seed"] for r in floods.collect()} == {(t, k): 9 if k < 4 else 2 for t in (0, 1) for k in range(8)}
    points = spark.createDataFrame([(0, 5, k, float(x + k), float(y)) for x, y in ((0, 0), (1, 0), (0, 1)) for k in range(30)], "time int, rwp_id long, node long, x double, y double")
    hulls = frames.node_hulls(points)
    got = {r["node"]: [tuple(p) for p in r["ring"]] for r in hulls.collect()}
    assert got == {k: frames.convex_hull([(k, 0), (k + 1, 0), (k, 1)]) for k in range(30)}
    groups = lambda d: re.search(r"FlatMapGroupsInPandas \[(.*?)\]", d._jdf.queryExecution().optimizedPlan().toString()).group(1)
    assert "region" not in groups(floods) and "node" not in groups(hulls)


def test_sweep_is_written_as_csv(spark, tmp_path):
    runs = spark.createDataFrame([("m", t, i, float(i == t), True) for t in (1.0, 2.0) for i in range(3)], "method string, threshold double, time int, iou double, agree boolean")
    compare.save_sweep(compare.sweep(runs), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True)
    assert [tuple(r)[:2] for r in back.collect()] == [("m", 1.0), ("m", 2.0)] and back.columns == ["method", "threshold", "mean_iou", "agreement", "n"]


FEATURE = "run string, time long, id long, node_type string, lon double, lat double, scalar double, ring array<struct<x:double,y:double>>, strength string"


def feature(t, i, x, strength="strong", lat=50.0, lon=None, kind="max"):
    return ("r", t, i, kind, float(x if lon is None else lon), lat, 1.0, [{"x": float(a), "y": float(b)} for a, b in ((x, 0), (x + 10, 0), (x + 10, 10), (x, 10))], strength)


@pytest.mark.parametrize(
    ("rows", "tracks"),
    [
        ([feature(0, 1, 0), feature(1, 1, 1), feature(2, 1, 2)], {"0:1": [0, 1, 2]}),
        ([feature(0, 1, 0), feature(1, 1, 50)], {"0:1": [0], "1:1": [1]}),
        ([feature(0, 1, 0), feature(1, 1, 1, "weak"), feature(2, 1, 2)], {"0:1": [0, 1, 2]}),
        # two recovered steps in a row, no more
        ([feature(0, 1, 0)] + [feature(t, 1, t, "weak") for t in range(1, 6)], {"0:1": [0, 1, 2]}),
        # the head leaves the band; a seed of the first step need not be in it, a later birth must
        ([feature(0, 1, 0), feature(1, 1, 1, lat=85.0)], {"0:1": [0]}),
        ([feature(0, 1, 0, lat=85.0), feature(0, 2, 50), feature(1, 3, 90, lat=85.0)], {"0:1": [0], "0:2": [0]}),
        # a split has its parent's steps too; a slight overlap splits nothing off, and is no birth either
        ([feature(0, 1, 0), feature(1, 1, 1), feature(1, 2, 3), feature(2, 2, 3)], {"0:1": [0, 1], "1:2": [0, 1, 2]}),
        ([feature(0, 1, 0), feature(1, 1, 1), feature(1, 2, 9.8)], {"0:1": [0, 1]}),
        # weak ones split too, whatever their overlap, but only from what no strong one goes on from
        ([feature(0, 1, 0), feature(1, 1, 1, "weak"), feature(1, 2, 9.8, "weak")], {"0:1": [0, 1], "1:2": [0, 1]}),
        ([feature(0, 1, 0), feature(1, 1, 1, "weak"), feature(1, 2, 3)], {"0:1": [0, 1]}),
        ([feature(0, 1, 0), feature(1, 1, 1, kind="min")], {"0:1": [0], "1:1": [1]}),
        # a step of time without features ends a track
        ([feature(0, 1, 0), feature(2, 1, 0)], {"0:1": [0], "2:1": [2]}),
    ],
)
def test_feature_tracks(spark, rows, tracks):
    steps = features.track(spark.createDataFrame(rows, FEATURE), save, band=(20.0, 80.0)).collect()
    got = {}
    for r in sorted(steps, key=lambda r: r["time"]):
        got.setdefault(r["track_id"], []).append(r["time"])
    assert got == tracks


def random_features(seed, times=9, n=7):
    rng = random.Random(seed)
    out = []
    for run in "ab":
        for t in range(times):
            for i in range(rng.randrange(n)):
                x = rng.randrange(0, 60)
                out.append((run, *feature(t, i, x, rng.choice(["strong", "strong", "weak"]), lat=float(rng.randrange(15, 85)), lon=float(x), kind=rng.choice(["max", "min"]))[1:]))
    return out


def plain_tracks(rows, shift=20.0, budget=2, band=(20.0, 80.0), least=0.05):
    """Step by step, with the histories, on lists."""
    out = []
    for run in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == run]
        box = lambda r: [(p["x"], p["y"]) for p in r[7]]
        live, tracks = [], {}
        for t in range(min(r[1] for r in own), max(r[1] for r in own) + 1):
            now, heads = [r for r in own if r[1] == t], list(live)
            first = t == min(r[1] for r in own)
            live, used = [], set()
            for strength in ("strong", "weak"):
                scored = sorted(((round(frames.iou(box(f), box(h[1])), 9), h[1][2], f[2], h, f) for h in heads for f in now if f[8] == strength and f[3] == h[1][3] and math.hypot((f[4] - h[1][4] + 180) % 360 - 180, f[5] - h[1][5]) <= shift and h[0] not in used), key=lambda x: x[:3], reverse=True)
                claimed, children = set(), {}
                for o, _, j, h, f in scored:
                    if o > 0 and j not in claimed:
                        claimed.add(j)
                        children.setdefault(h[0], []).append((o, f, h))
                used |= children.keys()
                for name, some in children.items():
                    before = list(tracks[name])
                    for nth, (o, f, h) in enumerate(some):
                        weak = h[2] + 1 if strength == "weak" else 0
                        if not band[0] <= f[5] <= band[1] or weak > budget or nth and not weak and o < least:
                            continue
                        to = name if nth == 0 else f"{t}:{f[2]}"
                        tracks[to] = [*before, (t, f[2], weak > 0)]
                        live.append((to, f, weak))
                if strength == "strong":
                    for f in now:
                        if f[8] == "strong" and f[2] not in claimed and (first or band[0] <= f[5] <= band[1]):
                            tracks[f"{t}:{f[2]}"] = [(t, f[2], False)]
                            live.append((f"{t}:{f[2]}", f, 0))
        out += [(run, k, *s) for k, v in tracks.items() for s in v]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_feature_tracks_against_a_plain_version(spark, seed):
    rows = random_features(seed)
    steps = features.track(spark.createDataFrame(rows, FEATURE), save, band=(20.0, 80.0)).collect()
    assert sorted((r["run"], r["track_id"], r["time"], r["id"], r["recovered"]) for r in steps) == plain_tracks(rows)


def test_velocity_and_lineage(spark):
    steps = features.track(spark.createDataFrame([feature(0, 1, 0, lon=359.5), feature(1, 1, 1, lon=0.5), feature(1, 2, 2, lon=3.0), feature(2, 2, 3, lon=3.0), feature(2, 3, 4, lon=3.5)], FEATURE), save)
    v = {r["track_id"]: r["degrees_per_hour"] for r in features.phase_velocity(steps).collect()}
    assert v["0:1"] is not None and features.roots(steps, save).filter("root = '0:1'").count() == len(v)
    # one degree an hour, across the date line
    east = features.track(spark.createDataFrame([feature(t, 1, t, lon=(359.0 + t) % 360) for t in range(4)], FEATURE), save)
    assert features.phase_velocity(east).first()["degrees_per_hour"] == 1


def test_streamed_tracks_equal_batch(spark, tmp_path):
    some = ([r for r in random_features(s, 5) if r[0] == "a"] for s in range(99))
    rows = next(x for x in some if {r[1] for r in x} == set(range(5)))
    batch = {tuple(r) for r in features.track(spark.createDataFrame(rows, FEATURE), save, history=False).collect()}
    src = str(tmp_path / "in")
    for t in range(5):
        spark.createDataFrame([r for r in rows if r[1] == t], FEATURE).coalesce(1).write.mode("append").parquet(src)
    stream = features.stream_track(spark.readStream.schema(FEATURE).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("steps").collect()}
    # the last step waits for a later one
    assert {r for r in batch if r[3] < 4} == got


def test_streamed_tracks_equal_batch_to_the_end(spark, tmp_path):
    """Runs of several lengths, one of a single step, with the ends of the runs as the last file."""
    rows = [(str(run), *feature(t, i, 20 * i + t)[1:]) for run, n in enumerate((5, 1, 3)) for t in range(n) for i in range(3)]
    df = spark.createDataFrame(rows, FEATURE)
    src = str(tmp_path / "in")
    for t in range(5):
        spark.createDataFrame([r for r in rows if r[1] == t], FEATURE).coalesce(1).write.mode("append").parquet(src)
    features.ends(df).coalesce(1).write.mode("append").parquet(src)
    stream = features.stream_track(spark.readStream.schema(FEATURE).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName("all_steps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch, got = (sorted((tuple(map(str, r)) for r in d.collect())) for d in (features.track(df, save, history=False), spark.table("all_steps")))
    assert got == batch and len(got) == 27


def test_streamed_query_gives_all_tracks(spark):
    at = "/root/testdata/sf0.001"
    batch, got = (sorted(tuple(map(str, r)) for r in queries.QUERIES[q](spark, at).collect()) for q in ("feature_tracks", "streamed_feature_tracks"))
    assert got == batch and got


def test_catalogue_on_disk(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 1, 2, "max", 10.0, 50.0, 5.0, 2, 0)], schema.TABLES["nodes"])
    catalogue_io.save({"nodes": nodes}, str(tmp_path), {"dt_hours": 12})
    c = Catalogue.load(spark, str(tmp_path))
    assert c.meta == {"hemisphere": "north", "dt_hours": 12} and c.nodes().count() == 1
    assert c.rwps().count() == 0 and c.rwps().columns[:2] == ["time", "rwp_id"]
    assert c.track_paths(save=save).count() == 0
    with pytest.raises(FileNotFoundError):
        catalogue_io.load_table(spark, str(tmp_path / "no"), "nodes")


def test_histograms(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [(r["left"], r["right"], r["density"]) for r in histogram(df, "x", 2).orderBy("left").collect()] == [(0.5, 1.0, 0.0), (1.0, 1.5, 2.0)]
    assert histogram(df.filter("false"), "x", 3).collect() == []


def test_association_sorts_no_candidates(spark):
    """Nearest of each kind by plain distances, with ties, points far from all, and steps that lack a kind or a contour; a
    frame's points meet its extrema in one group, and windows over frames share one shuffle."""
    rng = random.Random(5)
    spot = lambda t: (t, round(rng.uniform(-90, 90)), round(rng.uniform(0, 360)))
    contour = [spot(t) for t in (0, 1, 2, 4) for _ in range(40)] + [(0, 10, 30)] * 2
    high, low = ([(t, i, *spot(t)[1:], s * 30.0) for t in times for i in rng.sample(range(90), 9)] for s, times in ((1, (0, 1, 3, 4)), (-1, (0, 2, 3, 4))))
    # two at one place
    high += [(0, 95, 10, 20, 30.0), (0, 94, 10, 20, 30.0)]
    extrema = [spark.createDataFrame([(t, i, float(a), float(b), v) for t, i, a, b, v in some], "time int, id long, lat double, lon double, v double") for some in (high, low)]
    points = spark.createDataFrame([(t, float(a), float(b)) for t, a, b in contour], "time int, lat double, lon double")

    def near(t, lat, lon, some):
        xyz = lambda a, b: [math.cos(math.radians(a)) * math.cos(math.radians(b)), math.cos(math.radians(a)) * math.sin(math.radians(b)), math.sin(math.radians(a))]
        return min((round(math.dist(xyz(lat, lon), xyz(a, b)), 12), i) for s, i, a, b, _ in some if s == t)[1]

    want = {(t, near(t, a, b, high), near(t, a, b, low)) for t, a, b in contour if t in (0, 4)}
    pairs = association.associate(points, *extrema)
    rows = [tuple(r) for r in pairs.collect()]
    assert set(rows) == want and len(rows) == len(want) and any(m == 94 for _, m, _ in rows)
    assert association.associate(points.filter("false"), *extrema).collect() == []
    at = np.array([[rng.uniform(-1, 1) for _ in range(3)] for _ in range(30)])
    assert association._nearest(at, at[:7], 20).tolist() == association._nearest(at, at[:7]).tolist()
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    maxima = stencil.local_maxima(save(spark.createDataFrame([(t, i, j, 20.0 + i, 1.0 * j, float(i * j)) for t in range(2) for i in range(3) for j in range(4)], schema.FIELD)), 1.0)
    assert maxima._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_overlaps_of_a_runs_steps_at_once(monkeypatch):
    """Those of each step and the one before, near and of one type: as pair by pair, and none pair by pair."""
    rng = random.Random(6)

    def some(t):
        out = []
        for i in range(4):
            x, y = rng.uniform(0, 60), rng.uniform(30, 60)
            ring = [(x + a, y + b) for a, b in ((-20, -10), (20, -10), (20, 0), (0, 0), (0, 10), (-20, 10))]
            out.append({"time": t, "id": i, "lon": x, "lat": y, "node_type": rng.choice(("max", "min")), "strength": "strong", "ring": ring if rng.random() < 0.9 else []})
        return out

    times = [some(t) for t in range(6)]
    want = {}
    for before, now in zip(times, times[1:], strict=False):
        for f in now:
            for t in before:
                if f["node_type"] == t["node_type"] and math.hypot(f["lon"] - t["lon"], f["lat"] - t["lat"]) <= 20 and f["ring"] and t["ring"] and (o := features._iou(f["ring"], t["ring"])) > 0:
                    want[f["time"], f["id"], t["id"]] = o
    monkeypatch.setattr(features, "_iou", None)
    got = {k: v for k, v in features._overlaps(list(zip(times[1:], times, strict=False)), 20.0).items() if v > 0}
    assert got == pytest.approx(want, abs=2e-9) and len(want) > 5
    assert features._overlaps([(times[0], [])], 20.0) == {}
    after, steps = features.advance([], times[0], first=True)
    assert len(after) == len(steps) == 4
