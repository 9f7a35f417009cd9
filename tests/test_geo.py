import math

import pytest
from pyspark.sql import functions as F

from wavefold.config import Config
from wavefold.functions import geo
from wavefold.sources import staging


@pytest.fixture
def value(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "east"), [(5, 355, False), (355, 5, True), (10, 20, True), (0, 180, True), (180, 0, False)])
def test_is_east(value, a, b, east):
    assert value(geo.is_east(a, b)) is east


def test_longitudes(value):
    assert value(geo.lon_separation(358, 2)) == 4
    assert value(geo.signed_east(350, 10)) == 20 and value(geo.signed_east(10, 350)) == -20
    assert value(geo.arc_bins(10, 20)) == list(range(10, 31))
    assert value(geo.arcs_overlap(10, 20, 31, 10)) is False and value(geo.arcs_overlap(350, 30, 10, 10)) is True
    assert value(geo.lat_gap_within(20, 30, 40, 50, 10)) is True and value(geo.lat_gap_within(20, 30, 41, 50, 10)) is False
    assert value(geo.haversine_km(0, 0, 0, 180)) == pytest.approx(math.pi * 6371)
    assert value(geo.node_id(F.lit("min"), F.lit(4))) == -5 and value(geo.key(F.lit(3), F.lit(7))) == "3:7"
    assert value(geo.grid_bin(-1, 10)) == -10


def test_stereographic(value):
    x, y = geo.to_stereographic(0, 0)
    assert value(-y) == pytest.approx(12713600.098850505, abs=1e-3) and value(x) == 0
    for h, lat, lon in (("north", 52.5, 13.4), ("south", -33.0, 170.0)):
        x, y = geo.to_stereographic(lat, lon, h)
        la, lo = geo.from_stereographic(x, y, h)
        assert value(la) == pytest.approx(lat, abs=1e-9) and value(lo) == pytest.approx(lon, abs=1e-9)
    with pytest.raises(ValueError):
        geo.to_stereographic(0, 0, "east")


def test_centroid(spark):
    df = spark.createDataFrame([(0.0, 50.0, -1.0), (10.0, 50.0, 3.0)], "lon double, lat double, v double")
    lon, lat = geo.weighted_centroid("lon", "lat", "v")
    r = df.agg(lon.alias("lon"), lat.alias("lat")).first()
    assert r["lon"] == pytest.approx(9, abs=0.02) and r["lat"] == 50


def test_consistent_longitudes(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 350.0), ("b", 10.0), ("b", 50.0)], "g string, lon double")
    got = {(r["g"], r["lon"]) for r in geo.consistent_longitudes(df, "lon", ["g"], 100.0).collect()}
    assert got == {("a", 370.0), ("a", 350.0), ("b", 10.0), ("b", 50.0)}


def test_shared_folder_is_asked_for_off_local():
    class Fake:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://a:7077", "getCheckpointDir": lambda self: None})()

    with pytest.raises(RuntimeError):
        staging.path(Fake(), "x")


def test_config_round_trip(tmp_path):
    c = Config.default(min_latitude=20.0, lat_gate=10.0)
    assert Config.from_yaml(c.to_yaml()) == c
    c.to_yaml(tmp_path / "c.yaml")
    assert Config.from_yaml(tmp_path / "c.yaml") == c
    (tmp_path / "bad.yaml").write_text("nonsense: 1\n")
    with pytest.raises(TypeError):
        Config.from_yaml(tmp_path / "bad.yaml")
