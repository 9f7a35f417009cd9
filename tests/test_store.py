"""The field's store and the matching of points."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wavefold.functions import geo
from wavefold import schema
from wavefold.plans.catalogue import Catalogue
from wavefold.sources import field


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('field')}/store"
    df = spark.createDataFrame([(t, i, j, -90.0 + 12.5 * i, 60.0 * j, float(t + i * j)) for t in range(50) for i in range(15) for j in range(6)], schema.FIELD)
    field.write_store(df, at, steps=8, width=20.0)
    return df, at


@pytest.mark.parametrize("wanted", [{}, {"low": 20.0, "high": 47.5}, {"low": -65.0, "high": -52.5, "start": 7, "stop": 9}, {"start": 8, "stop": 16, "every": 3}, {"stop": 0}, {"start": 49, "every": 5}, {"low": 86.0, "high": 90.0}])
def test_store_reads_what_select_takes(spark, stored, wanted):
    df, at = stored
    want = field.select(df, low=wanted.get("low", -90.0), high=wanted.get("high", 90.0), start=wanted.get("start", 0), stop=wanted.get("stop"), every=wanted.get("every", 1))
    got = field.read_store(spark, at, **wanted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == df.columns


def test_store_reads_only_the_folders_that_it_needs(spark, stored):
    _, at = stored
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    some = field.read_store(spark, at, low=20.0, high=39.0, start=8, stop=16).select("v")
    plan = some._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\]]*band#\d+ >= 1\), \(band#\d+ <= 1\)", plan) and re.search(r"PartitionFilters: \[[^\]]*steps#\d+ >= 1\), \(steps#\d+ <= 1\)", plan)
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(lat,20.0)" in plan and "GreaterThanOrEqual(time,8)" in plan
    assert "ReadSchema: struct<time:int,lat:double,v:double>" in plan
    some.collect()
    metrics = some._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    # one folder of the 7 x 10
    assert metrics.apply("numPartitions").value() == 1


@pytest.mark.parametrize("radius", [0.0, 120.0, 850.0, 6000.0, 30_000.0])
def test_points_meet_packets_over_poles_and_seams(spark, radius):
    rng = random.Random(8)
    places = lambda n: [(t, rng.choice([-180.0, 179.9, 0.0, 359.5, rng.uniform(-180, 360)]), rng.choice([90.0, -90.0, 89.0, rng.uniform(-90, 90)])) for t in (0, 1) for _ in range(n)]
    packets, points = places(8), [*places(40), (0, None, 50.0), (2, 10.0, 50.0), (None, 0.0, 0.0)]
    points += [packets[0], packets[0]]
    rwps = spark.createDataFrame([(t, i, lon, lat, 1.0, 1, 0.0, None) for i, (t, lon, lat) in enumerate(packets)], schema.TABLES["rwps"])
    got = Catalogue({"rwps": rwps}, {}).match_points(spark.createDataFrame(points, "time bigint, lon double, lat double"), radius).collect()

    def km(p, q):
        (x, a), (y, b) = ((math.radians(v) for v in r[1:]) for r in (p, q))
        h = math.sin((a - b) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((x - y) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(min(h, 1)), math.sqrt(max(0.0, 1 - h)))

    want = sorted(((p, p[1] is not None and any(q[0] == p[0] and km(p, q) <= radius for q in packets)) for p in points), key=str)
    assert sorted((((r["time"], r["lon"], r["lat"]), r["matched"]) for r in got), key=str) == want


def test_points_among_many_packets_are_not_measured(spark, monkeypatch):
    """Distances are for small cubes that the radius cuts, not for all packets near a point."""
    rng = random.Random(9)
    near = lambda lon, lat: (0, lon + rng.uniform(-0.4, 0.4), lat + rng.uniform(-0.4, 0.4))
    rwps = spark.createDataFrame([(t, i, lon, lat, 1.0, 1, 0.0, None) for i, (t, lon, lat) in enumerate(near(10, 50) for _ in range(200))], schema.TABLES["rwps"])
    points = spark.createDataFrame([near(*at) for at in ((10, 50), (12, 53), (40, 50), (10, 80)) for _ in range(50)], "time bigint, lon double, lat double")
    monkeypatch.setattr(geo, "haversine_km", lambda *_: F.raise_error(F.concat(F.lit("measured "), F.lit("a pair"))).cast("double"))
    got = Catalogue({"rwps": rwps}, {}).match_points(points, 850.0).collect()
    assert len(got) == 200 and all(r["matched"] == (r["lon"] < 20 and r["lat"] < 60) for r in got)


def test_points_round_many_packets(spark):
    """Places on a ring as wide as the radius round a cloud of packets: some within it, some not."""
    rng = random.Random(10)
    packets = [(10 + rng.uniform(-1, 1), 50 + rng.uniform(-1, 1)) for _ in range(150)]
    points = [(10 + 14 * math.cos(a), 50 + 8.6 * math.sin(a)) for a in (rng.uniform(0, 6.28) for _ in range(150))]
    rwps = spark.createDataFrame([(0, i, lon, lat, 1.0, 1, 0.0, None) for i, (lon, lat) in enumerate(packets)], schema.TABLES["rwps"])

    def km(x, a, y, b):
        x, a, y, b = map(math.radians, (x, a, y, b))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((a - b) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((x - y) / 2) ** 2))

    got = Catalogue({"rwps": rwps}, {}).match_points(spark.createDataFrame([(0, *p) for p in points], "time bigint, lon double, lat double"), 850.0).collect()
    want = {p: any(km(*p, *q) <= 850 for q in packets) for p in points}
    assert {(r["lon"], r["lat"]): r["matched"] for r in got} == want and 20 < sum(want.values()) < 130
