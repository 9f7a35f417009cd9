"""Longitudes, great circles and the polar stereographic projection as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

EARTH_KM = 6371.0
#: WGS84: semi-major axis in metres and eccentricity.
A_METRES, ECC = 6378137.0, 0.0818191908426215


def _c(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def exact_haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """The same from the C library's functions, as SQL engines written in C have it to the last bit. Ways of one length come
    out equal or differ by a bit as the functions round, and what is nearest by one library may not be by another."""

    def km(lat1, lon1, lat2, lon2):
        lat1, lon1, lat2, lon2 = (x * (math.pi / 180) for x in (lat1, lon1, lat2, lon2))
        a = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
        a = min(max(a, 0.0), 1.0)
        return 2 * EARTH_KM * math.atan2(math.sqrt(a), math.sqrt(1 - a))

    def run(*columns):
        rows = zip(*(c.astype(float) for c in columns), strict=True)
        return pd.Series([None if any(map(math.isnan, row)) else km(*row) for row in rows], dtype=float)

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)(*(_c(x) for x in (lat1, lon1, lat2, lon2)))


def is_east(lon1, lon2) -> Column:
    """Whether lon2 lies short-arc east of lon1; a difference of exactly 180 keeps its sign."""
    d = _c(lon2) - _c(lon1)
    return F.when(F.abs(d) > 180, -d).otherwise(d) > 0


def lon_separation(lon1, lon2) -> Column:
    m = F.pmod(F.abs(_c(lon1) - _c(lon2)), F.lit(360.0))
    return F.least(m, 360.0 - m)


def signed_east(lon1, lon2) -> Column:
    return F.pmod(_c(lon2) - _c(lon1) + 180.0, F.lit(360.0)) - 180.0


def zonal_fraction(lat1, lon1, lat2, lon2) -> Column:
    dlon, dlat = lon_separation(lon1, lon2), F.abs(_c(lat1) - _c(lat2))
    return dlon / F.greatest(F.sqrt(dlon * dlon + dlat * dlat), F.lit(1e-6))


def edge_weight(max_scalar, min_scalar, lat1, lon1, lat2, lon2) -> Column:
    """Scalar difference over distance, times the zonal part of the way."""
    dist = F.greatest(haversine_km(lat1, lon1, lat2, lon2), F.lit(1e-6))
    return (_c(max_scalar) - _c(min_scalar)) / dist * zonal_fraction(lat1, lon1, lat2, lon2)


def aspect_ratio(lat1, lon1, lat2, lon2) -> Column:
    return F.abs(_c(lat1) - _c(lat2)) / F.greatest(lon_separation(lon1, lon2), F.lit(1e-6))


def lon_separation_km(lat1, lon1, lat2, lon2) -> Column:
    """The longitude difference as a way along the mean latitude."""
    return EARTH_KM * F.radians(lon_separation(lon1, lon2)) * F.cos(F.radians((_c(lat1) + _c(lat2)) / 2))


def _sign(hemisphere: str) -> float:
    if hemisphere not in ("north", "south"):
        raise ValueError(f"hemisphere must be 'north' or 'south', not {hemisphere!r}")
    return 1.0 if hemisphere == "north" else -1.0


def to_stereographic(lat, lon, hemisphere: str = "north") -> tuple[Column, Column]:
    """x, y in metres: polar stereographic, WGS84, scale 1 at the pole, central meridian 0."""
    s = _sign(hemisphere)
    phi = F.radians(_c(lat)) * s
    con = ECC * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - con) / (1 + con), ECC / 2)
    rho = 2 * A_METRES / math.sqrt((1 + ECC) ** (1 + ECC) * (1 - ECC) ** (1 - ECC)) * t
    lam = F.radians(_c(lon))
    return rho * F.sin(lam), -s * rho * F.cos(lam)


def from_stereographic(x, y, hemisphere: str = "north") -> tuple[Column, Column]:
    """lat, lon (-180 to 180) by six rounds of the latitude's fixed point."""
    s = _sign(hemisphere)
    x, y = _c(x), _c(y)
    t = F.sqrt(x * x + y * y) * math.sqrt((1 + ECC) ** (1 + ECC) * (1 - ECC) ** (1 - ECC)) / (2 * A_METRES)

    def closer(phi, _):
        con = ECC * F.sin(phi)
        return math.pi / 2 - 2 * F.atan(t * F.pow((1 - con) / (1 + con), ECC / 2))

    # a fold, since an expression that holds the one before twice doubles with each round
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), math.pi / 2 - 2 * F.atan(t), closer)
    return F.degrees(phi) * s, F.degrees(F.atan2(x, -s * y))


def arc_bins(start, length) -> Column:
    """Whole-degree bins that an arc of ``length`` degrees east of ``start`` touches."""
    n = F.floor(_c(length)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.pmod(F.bround(F.pmod(_c(start) + k, F.lit(360.0))), F.lit(360.0)).cast("int"))


def arcs_overlap(start1, length1, start2, length2) -> Column:
    return F.arrays_overlap(arc_bins(start1, length1), arc_bins(start2, length2))


def lat_gap_within(low1, high1, low2, high2, gate) -> Column:
    """Whether two latitude ranges meet or lie at most ``gate`` apart."""
    return F.greatest(_c(low1), _c(low2)) - F.least(_c(high1), _c(high2)) <= _c(gate)


def node_id(node_type, index) -> Column:
    """Maxima keep their index, minima become -index - 1."""
    return F.when(_c(node_type) == "max", _c(index)).otherwise(-_c(index) - 1)


def key(time, feature) -> Column:
    return F.concat_ws(":", _c(time).cast("string"), _c(feature).cast("string"))


def strength(scalar, threshold) -> Column:
    return F.when(F.abs(_c(scalar)) >= _c(threshold), "strong").otherwise("weak")


def grid_bin(x, size) -> Column:
    return F.floor(_c(x) / _c(size)) * _c(size)


def consistent_longitudes(df: DataFrame, lon: str, by: list[str], least: float = 0.0) -> DataFrame:
    """In groups that span more than 60 degrees, 360 is added to longitudes below ``least``."""
    span = df.groupBy(*by).agg((F.max(lon) - F.min(lon)).alias("_span"))
    wide = (F.col("_span") > 60) & (F.col(lon) < least)
    return df.join(span, by).withColumn(lon, F.when(wide, F.col(lon) + 360).otherwise(F.col(lon))).select(*df.columns)


def weighted_centroid(lon, lat, value) -> tuple[Column, Column]:
    """Aggregates: circular mean longitude (-180 to 180) and mean latitude, both weighted by value squared."""
    w = _c(value) * _c(value)
    x, y = F.sum(w * F.cos(F.radians(_c(lon)))), F.sum(w * F.sin(F.radians(_c(lon))))
    return F.degrees(F.atan2(y, x)), F.try_divide(F.sum(w * _c(lat)), F.sum(w))
