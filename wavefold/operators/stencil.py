"""Per-frame operators on long field tables, with windows and joins on the grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.staging import spread


def _extremes(df: DataFrame, sign: int) -> DataFrame:
    """v against the 3 x 3 extreme: longitudes wrap, and beyond the first and last latitude stands 0."""
    pick, both = (F.max, F.greatest) if sign > 0 else (F.min, F.least)
    size = Window.partitionBy("time")
    # one shuffle, by frames, serves all windows
    ends = spread(df, "time").withColumn("n_lon", F.max("lon_idx").over(size) + 1).withColumn("n_lat", F.max("lat_idx").over(size) + 1)
    # the first and the last column come a second time, beyond the other end
    twice = F.when(F.col("lon_idx") == 0, F.array(F.lit(0), F.col("n_lon"))).when(F.col("lon_idx") == F.col("n_lon") - 1, F.array(F.col("lon_idx"), F.lit(-1))).otherwise(F.array("lon_idx"))
    wide = ends.withColumn("at", F.explode(twice))
    row = Window.partitionBy("time", "lat_idx").orderBy("at").rowsBetween(-1, 1)
    across = wide.withColumn("m", pick("v").over(row)).filter(F.col("at") == F.col("lon_idx"))
    col = Window.partitionBy("time", "lon_idx").orderBy("lat_idx").rowsBetween(-1, 1)
    whole = across.withColumn("m", pick("m").over(col))
    edge = (F.col("lat_idx") == 0) | (F.col("lat_idx") == F.col("n_lat") - 1)
    return whole.withColumn("m", F.when(edge, both("m", F.lit(0.0))).otherwise(F.col("m")))


def local_maxima(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Cells that equal their 3 x 3 maximum (ties too), strictly above ``threshold``; lon runs from 0 to 360 inclusive."""
    out = _extremes(df, 1).filter(F.col("v") == F.col("m"))
    out = out if threshold is None else out.filter(F.col("v") > threshold)
    return out.select("time", "lat_idx", "lon_idx", "lat", _stretched().alias("lon"), "v")


def local_minima(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """As local_maxima, strictly below -``threshold``; the first latitude has no minima."""
    out = _extremes(df, -1).filter((F.col("v") == F.col("m")) & (F.col("lat_idx") > 0))
    out = out if threshold is None else out.filter(F.col("v") < -threshold)
    return out.select("time", "lat_idx", "lon_idx", "lat", _stretched().alias("lon"), "v")


def _stretched() -> Column:
    return F.coalesce(F.try_divide(F.lit(360.0) * F.col("lon_idx"), F.col("n_lon") - 1), F.lit(0.0))


def zero_contour(df: DataFrame) -> DataFrame:
    """Where the field changes sign between neighbours east or north, by linear interpolation in lat and lon."""
    # one shuffle, by frames, serves both windows
    frames = spread(df, "time")
    near = lambda by, along: F.lead(F.struct("lat", "lon", "v", F.col(along).alias("at"))).over(Window.partitionBy("time", by).orderBy(along))
    both = frames.select("*", near("lat_idx", "lon_idx").alias("east"), near("lon_idx", "lat_idx").alias("north"))
    side = F.explode(F.array(F.when(F.col("east.at") == F.col("lon_idx") + 1, F.col("east")), F.when(F.col("north.at") == F.col("lat_idx") + 1, F.col("north"))))
    pairs = both.select("time", "lat", "lon", "v", side.alias("n")).select("time", "lat", "lon", "v", F.col("n.lat").alias("lat2"), F.col("n.lon").alias("lon2"), F.col("n.v").alias("v2"))
    crossed = pairs.filter(((F.col("v") < 0) & (F.col("v2") >= 0)) | ((F.col("v") >= 0) & (F.col("v2") < 0)))
    f = F.try_divide("v", F.col("v") - F.col("v2"))
    return crossed.select("time", (F.col("lat") + f * (F.col("lat2") - F.col("lat"))).alias("lat"), (F.col("lon") + f * (F.col("lon2") - F.col("lon"))).alias("lon"))


def running_mean(df: DataFrame, n: int) -> DataFrame:
    """Centred mean over n steps at each cell; beyond the ends the first and the last value are repeated."""
    before, after = n // 2, (n - 1) // 2
    w = Window.partitionBy("lat_idx", "lon_idx").orderBy("time")
    # a row for each cell of the grid
    ends = df.groupBy("lat_idx", "lon_idx").agg(F.min_by("v", "time").alias("begin"), F.max_by("v", "time").alias("end"), F.count("*").alias("last"))
    at = df.withColumn("pos", F.row_number().over(w)).withColumn("near", F.sum("v").over(w.rowsBetween(-before, after))).join(ends, ["lat_idx", "lon_idx"])
    lead_in, lead_out = F.greatest(F.lit(before) + 1 - F.col("pos"), F.lit(0)), F.greatest(F.col("pos") + after - F.col("last"), F.lit(0))
    total = F.col("near") + lead_in * F.col("begin") + lead_out * F.col("end")
    return at.select("time", "lat_idx", "lon_idx", (total / n).alias("v"))


def hovmoller(df: DataFrame) -> DataFrame:
    return df.groupBy("time", "lon_idx").agg(F.avg("v").alias("v"))


def magnitude_percentile(df: DataFrame, p: float = 0.99) -> DataFrame:
    return df.groupBy("time").agg(F.percentile(F.abs("v"), p).alias("p"))


def envelope(df: DataFrame, low: int = 3, high: int = 11, n_lon: int = 144) -> DataFrame:
    """Magnitude of the analytic signal of wave numbers low to high along each latitude, as two sums over waves."""
    turn = 2 * math.pi / n_lon
    k = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("k")
    waves = df.select("time", "lat_idx", "lon_idx", "v", k)
    angle = F.lit(turn) * F.pmod(F.col("k") * F.col("lon_idx"), F.lit(n_lon))
    parts = waves.groupBy("time", "lat_idx", "k").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(-F.col("v") * F.sin(angle)).alias("im"))
    spectrum = parts.groupBy("time", "lat_idx").agg(F.sort_array(F.collect_list(F.struct("k", "re", "im"))).alias("s"))
    add = lambda f: F.aggregate("s", F.lit(0.0), f)
    at = lambda x: F.lit(turn) * F.pmod(x["k"] * F.col("lon_idx"), F.lit(n_lon))
    re = add(lambda s, x: s + x["re"] * F.cos(at(x)) - x["im"] * F.sin(at(x)))
    im = add(lambda s, x: s + x["re"] * F.sin(at(x)) + x["im"] * F.cos(at(x)))
    z = df.join(spectrum, ["time", "lat_idx"]).select("time", "lat_idx", "lon_idx", re.alias("re"), im.alias("im"))
    return z.select("time", "lat_idx", "lon_idx", (F.lit(2 / n_lon) * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("envelope"))
