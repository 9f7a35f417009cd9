"""Crests and troughs as a graph: association through the zero contour, pruning, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..sources.staging import spread


def _xyz(lat: str, lon: str) -> list:
    a, b = F.radians(lat), F.radians(lon)
    return [x.alias(c) for x, c in zip((F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)), "xyz", strict=True)]


def _nearest(points: np.ndarray, extrema: np.ndarray, at_once: int = 2**20) -> np.ndarray:
    """For each point (x, y, z) the first of the extrema at the least chord, a block of points at a time."""
    size = max(at_once // max(len(extrema), 1), 1)
    out = np.zeros(len(points), np.int64)
    for k in range(0, len(points), size):
        x, y, z = ((points[k : k + size, None, i] - extrema[None, :, i]) ** 2 for i in range(3))
        d = x + y + z
        # what has no place is far from all
        out[k : k + size] = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
    return out


def associate(contour: DataFrame, maxima: DataFrame, minima: DataFrame) -> DataFrame:
    """Distinct pairs (time, max_id, min_id): of each contour point the nearest maximum and the nearest minimum of its time
    step (by chord, ties to the smaller id). A frame's points meet its extrema in one group, of which distances are made a
    block at a time; frames are dealt to tasks, which sort rows of places, never candidates."""
    places = spread(contour.select("time", *_xyz("lat", "lon")), "time")
    ends = maxima.select(F.lit(1).alias("kind"), "time", "id", "lat", "lon").unionByName(minima.select(F.lit(-1).alias("kind"), "time", "id", "lat", "lon"))
    ends = spread(ends.select(F.col("time").alias("on_time"), "kind", F.col("id").cast("long").alias("id"), *_xyz("lat", "lon")), "on_time")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        points, right = left[["x", "y", "z"]].to_numpy(float), right.sort_values("id")
        kinds = [(right["id"].to_numpy()[own], right[["x", "y", "z"]].to_numpy(float)[own]) for own in (right["kind"].to_numpy() == k for k in (1, -1))]
        if not len(points) or not all(len(i) for i, _ in kinds):
            return pd.DataFrame({"time": [], "max_id": [], "min_id": []})
        found = np.unique(np.stack([i[_nearest(points, at)] for i, at in kinds], axis=1), axis=0)
        return pd.DataFrame({"time": left["time"].iloc[0], "max_id": found[:, 0], "min_id": found[:, 1]})

    kind = contour.schema["time"].dataType.simpleString()
    return places.groupBy("time").cogroup(ends.groupBy("on_time")).applyInPandas(run, f"time {kind}, max_id long, min_id long")


def weigh(pairs: DataFrame, maxima: DataFrame, minima: DataFrame) -> DataFrame:
    """Pairs with the places and scalars of both ends, distance, weight and shape."""
    a = maxima.select("time", F.col("id").alias("max_id"), F.col("lat").alias("max_lat"), F.col("lon").alias("max_lon"), F.col("v").alias("max_v"))
    b = minima.select("time", F.col("id").alias("min_id"), F.col("lat").alias("min_lat"), F.col("lon").alias("min_lon"), F.col("v").alias("min_v"))
    ends = ("max_lat", "max_lon", "min_lat", "min_lon")
    out = pairs.join(a, ["time", "max_id"]).join(b, ["time", "min_id"])
    return out.withColumns({"distance": geo.haversine_km(*ends), "weight": geo.edge_weight("max_v", "min_v", *ends), "dlon": geo.lon_separation("max_lon", "min_lon"), "aspect": geo.aspect_ratio(*ends)})


def prune_nodes(edges: DataFrame, threshold: float, cap: float = 100.0) -> DataFrame:
    """Edges whose weaker end has at least ``threshold`` and at most ``cap``."""
    return edges.filter(F.least("max_v", -F.col("min_v")).between(threshold, cap))


def prune_edges(edges: DataFrame, low: float, high: float, *, min_dlon: float = 6.0, max_aspect: float = 1.5) -> DataFrame:
    return edges.filter((F.col("dlon") > min_dlon) & (F.col("aspect") <= max_aspect) & F.col("weight").between(low, high))


def length_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("time").agg(F.count("*").alias("n_edges"), F.avg("distance").alias("mean_km"), F.percentile("distance", 0.5).alias("median_km"), F.max("distance").alias("max_km"))


def summarise_clusters(points: DataFrame, by: list[str]) -> DataFrame:
    """Per cluster: members, the strongest scalar, its id (ties to the smaller), and the centroid weighted by |scalar|
    with longitudes unwrapped around the first member's."""
    base = points.groupBy(*by).agg(F.min_by("lon", "id").alias("base"))
    at = points.join(base, by).withColumn("shift", geo.signed_east("base", "lon"))
    w = F.abs("scalar")
    return at.groupBy(*by).agg(F.count("*").alias("n"), F.max(w).alias("peak"), F.max_by("id", F.struct(w, -F.col("id"))).alias("strongest"), F.pmod(F.min("base") + F.try_divide(F.sum(w * F.col("shift")), F.sum(w)), F.lit(360.0)).alias("lon"), F.try_divide(F.sum(w * F.col("lat")), F.sum(w)).alias("lat"))
