"""The catalogue: six tables, filters that compose lazily, and the queries over them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..operators import tracking
from ..sources import catalogue_io
from ..sources.staging import save

PACKET = ["time", "rwp_id"]


def packet_summary(nodes: DataFrame) -> DataFrame:
    """(time, rwp_id): v²-weighted centroid (to nine places), peak amplitude, nodes, and the widest short-arc separation of two nodes."""
    lon, lat = geo.weighted_centroid("lon", "lat", "scalar")
    base = nodes.groupBy(*PACKET).agg(F.round(lon, 9).alias("weighted_lon"), F.round(lat, 9).alias("weighted_lat"), F.max(F.abs("scalar")).alias("peak_amp"), F.count("*").alias("n_nodes"))
    # pairs are of a packet's distinct longitudes only, of which a grid has a fixed number
    arc = nodes.groupBy(*PACKET).agg(F.sort_array(F.collect_set(F.pmod("lon", F.lit(360.0)))).alias("lons"))
    sep = lambda x, y: F.least(F.abs(x - y), 360.0 - F.abs(x - y))
    widest = F.array_max(F.transform("lons", lambda x: F.array_max(F.transform("lons", lambda y: sep(x, y)))))
    return base.join(arc.select(*PACKET, widest.alias("zonal_extent_deg")), PACKET).withColumn("geometry_wkb", F.lit(None).cast("binary"))


def path_edges(nodes: DataFrame, order: str = "cluster_id") -> DataFrame:
    after = F.lead("node_id").over(Window.partitionBy(*PACKET).orderBy(order))
    return nodes.select(*PACKET, F.col("node_id").alias("src_node_id"), after.alias("dst_node_id")).filter("dst_node_id IS NOT NULL")


def histogram(df: DataFrame, column: str, bins: int | list[float]) -> DataFrame:
    """Density per bin, empty bins included, the last one closed; a single value is widened by a half on both sides."""
    if isinstance(bins, int):
        low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
        if low is None:
            return df.select(F.lit(0.0).alias("left"), F.lit(0.0).alias("right"), F.lit(0.0).alias("density")).limit(0)
        low, high = (low - 0.5, high + 0.5) if low == high else (float(low), float(high))
        edges = [low + (high - low) * i / bins for i in range(bins + 1)]
    else:
        edges = [float(x) for x in bins]
    k = sum((F.col(column) >= e).cast("int") for e in edges[1:-1]) if len(edges) > 2 else F.lit(0)
    inside = df.filter(F.col(column).between(edges[0], edges[-1])).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    rows = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)], "bin int, left double, right double")
    all_ = rows.join(inside, "bin", "left").select("left", "right", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the bins
    return all_.select("left", "right", F.coalesce(F.try_divide(F.col("n"), total * (F.col("right") - F.col("left"))), F.lit(0.0)).alias("density"))


@dataclass(frozen=True)
class Catalogue:
    tables: dict[str, DataFrame]
    meta: dict = field(default_factory=dict)
    predicates: dict = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalogue:
        names = ["nodes", "edges", "rwps", "samples", "track_nodes", "track_edges"]
        return cls({n: catalogue_io.load_table(spark, path, n) for n in names}, catalogue_io.load_meta(spark, path))

    def save(self, path: str, **options) -> None:
        catalogue_io.save(self.tables, path, self.meta, **options)

    def filter(self, **predicates) -> Catalogue:
        """time=, peak_amp_min=, region=(west, east, south, north); later ones override, unknown ones are ignored."""
        return replace(self, predicates=self.predicates | predicates)

    def _apply(self, df: DataFrame, lon: str | None = None, lat: str | None = None, amp: str | None = None) -> DataFrame:
        p = self.predicates
        if "time" in p:
            df = df.filter(F.col("time") == p["time"])
        if amp and "peak_amp_min" in p:
            df = df.filter(F.col(amp) >= p["peak_amp_min"])
        if lon and "region" in p:
            df = df.filter(self.inside(p["region"], lon, lat))
        return df

    @staticmethod
    def inside(region: tuple, lon: str, lat: str) -> Column:
        west, east, south, north = region
        return F.col(lon).between(west, east) & F.col(lat).between(south, north)

    def rwps(self) -> DataFrame:
        return self._apply(self.tables["rwps"], "weighted_lon", "weighted_lat", "peak_amp")

    def nodes(self) -> DataFrame:
        return self._apply(self.tables["nodes"], "lon", "lat")

    def samples(self) -> DataFrame:
        return self._apply(self.tables["samples"], "lon", "lat")

    def edges(self) -> DataFrame:
        return self._apply(self.tables["edges"])

    def tracks(self) -> tuple[DataFrame, DataFrame]:
        return self.tables["track_nodes"], self.tables["track_edges"]

    def rwps_in(self, region: tuple) -> DataFrame:
        return self.rwps().filter(self.inside(region, "weighted_lon", "weighted_lat"))

    def amplitudes(self) -> DataFrame:
        return self.rwps().select(*PACKET, "peak_amp")

    def zonal_extent(self) -> DataFrame:
        return self.rwps().select(*PACKET, "zonal_extent_deg")

    def implied_wavenumber(self) -> DataFrame:
        """180 over the mean gap of neighbouring longitudes; null for fewer than two nodes or no gap."""
        gap = F.col("lon") - F.lag("lon").over(Window.partitionBy(*PACKET).orderBy("lon"))
        return self.nodes().withColumn("gap", gap).groupBy(*PACKET).agg(F.avg("gap").alias("gap")).select(*PACKET, F.try_divide(F.lit(180.0), "gap").alias("wavenumber"))

    def amplitude_pdf(self, bins: int | list[float] = 20) -> DataFrame:
        return histogram(self.rwps(), "peak_amp", bins)

    def seasonal_cycle(self, months: DataFrame | None = None) -> DataFrame:
        """Packets by time, or by the month that ``months`` (time, month) gives it."""
        if months is None:
            return self.rwps().groupBy("time").agg(F.count("*").alias("n"))
        return self.rwps().join(months, "time").groupBy("month").agg(F.count("*").alias("n"))

    def spatial_frequency(self, dlon: float = 10.0, dlat: float = 10.0) -> DataFrame:
        return self.rwps().groupBy(geo.grid_bin("weighted_lon", dlon).alias("lon_bin"), geo.grid_bin("weighted_lat", dlat).alias("lat_bin")).agg(F.count("*").alias("n"))

    def amplitude_extent_correlation(self) -> DataFrame:
        """Null for up to two packets or a constant side."""
        varied = (F.count("*") > 2) & (F.min("peak_amp") < F.max("peak_amp")) & (F.min("zonal_extent_deg") < F.max("zonal_extent_deg"))
        return self.rwps().agg(F.when(varied, F.corr("peak_amp", "zonal_extent_deg")).alias("r"))

    def packet_at(self, lon: float, lat: float, time: int) -> DataFrame:
        """The packet whose centroid is nearest; no row if the step has none."""
        d = geo.exact_haversine_km("weighted_lat", "weighted_lon", lat, lon)
        return self.rwps().filter(F.col("time") == time).withColumn("km", d).groupBy("time").agg(F.min(F.struct("km", "rwp_id")).alias("x")).select("time", "x.rwp_id", "x.km")

    def phase_at(self, lon: float, lat: float, time: int) -> DataFrame:
        """Type of the nearest node of the nearest packet, and where the longitude falls between its bracketing nodes."""
        n = self.nodes().join(self.packet_at(lon, lat, time).select(*PACKET), PACKET)
        d = geo.exact_haversine_km("lat", "lon", lat, lon)
        west, east = F.max(F.when(F.col("lon") <= lon, F.col("lon"))), F.min(F.when(F.col("lon") > lon, F.col("lon")))
        x = n.withColumn("km", d).groupBy(*PACKET).agg(F.min(F.struct("km", "node_id", "node_type")).alias("x"), west.alias("west"), east.alias("east"))
        return x.select(*PACKET, "x.node_type", F.try_divide(F.lit(lon) - F.col("west"), F.col("east") - F.col("west")).alias("fraction"))

    def match_points(self, points: DataFrame, radius_km: float = 850.0) -> DataFrame:
        """``points`` (lon, lat, time) with whether a packet of that time lies within the radius. Places are in cubes in
        space, so that poles and seams are like other places. One with a packet in its cube of half the radius's chord is
        matched. What is left meets small cubes with packets, of which there are so many at most, however many packets;
        only packets of those that the radius cuts are measured, and only if no small cube is wholly within it."""
        chord, parts = 2 * math.sin(min(radius_km / (2 * geo.EARTH_KM), math.pi / 2)), 16
        size = (chord * (1 + 1e-9) if chord > 0 else 1e-9) / parts
        place, cube, wide = ["time", "lon", "lat"], ["_0", "_1", "_2"], ["w0", "w1", "w2"]

        def placed(df: DataFrame, lat: str, lon: str) -> DataFrame:
            a, b = F.radians(lat), F.radians(lon)
            df = df.withColumns({"x0": F.cos(a) * F.cos(b), "x1": F.cos(a) * F.sin(b), "x2": F.sin(a)})
            # neither null nor NaN
            return df.filter(F.col("x0").between(-1, 1) & F.col("x1").between(-1, 1) & F.col("x2").between(-1, 1)).withColumns({c: F.floor(F.col(f"x{c[1]}") / size) for c in cube})

        def larger(df: DataFrame, n: int) -> DataFrame:
            return df.withColumns({w: F.floor(F.col(c) / n) for w, c in zip(wide, cube, strict=True)})

        r = save(placed(self.rwps().select("time", "weighted_lon", "weighted_lat"), "weighted_lat", "weighted_lon").select("time", "weighted_lon", "weighted_lat", *cube), "packets")
        full = r.select("time", *cube).distinct()
        near = larger(full, parts // 2).select("time", *wide).distinct().withColumn("sure", F.lit(chord > 0))
        known = save(larger(placed(points.select(*place).distinct(), "lat", "lon"), parts // 2).join(near, ["time", *wide], "left").drop(*wide, *cube), "places")
        rest = larger(placed(known.filter("sure IS NULL OR NOT sure").select(*place), "lat", "lon"), parts).drop(*cube)
        for w in wide:
            rest = rest.withColumn(w, F.explode(F.array(*(F.col(w) + i for i in (-1, 0, 1)))))
        middle = sum((F.col(f"x{c[1]}") - (F.col(c) + 0.5) * size) ** 2 for c in cube)
        met = rest.join(larger(full, parts), ["time", *wide]).withColumn("d", F.sqrt(middle)).filter(F.col("d") <= size * (parts + 1))
        met = save(met.select(*place, *cube, (F.col("d") + size <= chord).alias("sure")), "met")
        held = met.filter("sure").select(*place).distinct()
        cut = met.filter("NOT sure").join(held, place, "left_anti").join(r, ["time", *cube])
        cut = cut.filter(geo.haversine_km("lat", "lon", "weighted_lat", "weighted_lon") <= radius_km).select(*place).distinct()
        hits = known.filter("sure").select(*place).unionByName(held).unionByName(cut)
        out = points.join(hits.withColumn("matched", F.lit(True)), place, "left")
        return out.select(*points.columns, F.coalesce("matched", F.lit(False)).alias("matched"))

    def path_statistics(self) -> DataFrame:
        """(time, n_packets, edges_per_packet, mean_km, median_km, max_km, extent_km) by time step: lengths of the edges of
        packets' paths, and their sum for each packet."""
        n = self.nodes().select(*PACKET, "node_id", "lon", "lat")
        end = lambda c, i: n.select(*PACKET, F.col("node_id").alias(c), F.col("lon").alias(f"lon{i}"), F.col("lat").alias(f"lat{i}"))
        km = geo.haversine_km("lat1", "lon1", "lat2", "lon2")
        e = self.edges().join(end("src_node_id", 1), [*PACKET, "src_node_id"]).join(end("dst_node_id", 2), [*PACKET, "dst_node_id"]).select(*PACKET, km.alias("km"))
        # a packet of one node has no edges, and counts
        each = n.groupBy(*PACKET).agg(F.lit(0).alias("zero")).join(e.groupBy(*PACKET).agg(F.count("*").alias("n"), F.sum("km").alias("extent")), PACKET, "left")
        packets = each.groupBy("time").agg(F.count("*").alias("n_packets"), F.avg(F.coalesce("n", F.lit(0))).alias("edges_per_packet"), F.avg(F.coalesce("extent", F.lit(0.0))).alias("extent_km"))
        lengths = e.groupBy("time").agg(F.avg("km").alias("mean_km"), F.percentile("km", 0.5).alias("median_km"), F.max("km").alias("max_km"))
        return packets.join(lengths, "time", "left")

    def anomalies(self, gate: float = 15.0, order: str = "cluster_id") -> DataFrame:
        """(time, single, interleaved): how many packets have one node, and how many share arcs and a band of latitude
        with another of their step. No pairs are made: packets are counted by the degrees that their arcs cover and by
        cells of their low ends, half as high as the gate. All in one cell meet; one that is alone in its cell meets
        another if the highest end below or the lowest above is within the gate."""
        w = Window.partitionBy(*PACKET).orderBy(order)
        step = geo.lon_separation(F.lag("lon").over(w), F.col("lon"))
        shape = self.nodes().withColumn("step", step).groupBy(*PACKET).agg(F.count("*").alias("n"), F.min_by("lon", order).alias("start"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("arc"), F.min("lat").alias("low"), F.max("lat").alias("high"))
        shape = shape.withColumn("cell", F.floor(F.col("low") / (gate / 2)) if gate > 0 else F.col("low"))
        # an arc of a turn or more covers all degrees
        bins = F.array_distinct(geo.arc_bins("start", F.least("arc", F.lit(360.0))))
        covered = shape.filter(F.col("low") - F.col("high") <= gate).select("time", "cell", "low", "high", F.explode(bins).alias("bin"))
        # a row for each step, degree and cell, however many packets there are
        cells = covered.groupBy("time", "bin", "cell").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        w = Window.partitionBy("time", "bin").orderBy("cell")
        below, above = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lead("low").over(w)
        cells = cells.select("*", below.alias("below"), above.alias("above"))
        met = (F.col("n") > 1) | F.coalesce(F.col("low") - F.col("below") <= gate, F.lit(False)) | F.coalesce(F.col("above") - F.col("high") <= gate, F.lit(False))
        where = cells.filter(met).groupBy("time", "cell").agg(F.collect_set("bin").alias("met"))
        both = shape.join(where, ["time", "cell"], "left").withColumn("meets", F.arrays_overlap(bins, "met"))
        return both.groupBy("time").agg(F.count_if(F.col("n") == 1).alias("single"), F.count_if("meets").alias("interleaved"))

    def merges(self) -> DataFrame:
        return tracking.merges(self.tables["track_edges"])

    def splits(self) -> DataFrame:
        return tracking.splits(self.tables["track_edges"])

    def track_paths(self, **options) -> DataFrame:
        """Tracks (track_id, pos, key) of the unpruned graph."""
        return tracking.track_paths(self.tables["track_edges"], **options)

    def _ends(self, paths: DataFrame) -> DataFrame:
        v = paths.join(self.tables["track_nodes"], "key")
        last, first = F.max_by(F.struct("time", "lon", "lat", "key"), "pos"), F.min_by(F.struct("time", "lon", "lat", "key"), "pos")
        return v.groupBy("track_id").agg(first.alias("a"), last.alias("b"))

    def track_durations(self, paths: DataFrame) -> DataFrame:
        hours = float(self.meta.get("dt_hours", self.meta.get("cadence_hours", 6)))
        return self._ends(paths).select("track_id", ((F.col("b.time") - F.col("a.time")) * hours).alias("hours"))

    def duration_pdf(self, paths: DataFrame, bins: int | list[float] = 10) -> DataFrame:
        return histogram(self.track_durations(paths), "hours", bins)

    def longest_tracks(self, paths: DataFrame, n: int = 8) -> DataFrame:
        """The ``n`` tracks that last longest; ties to the smaller number."""
        return self.track_durations(paths).orderBy(F.col("hours").desc(), "track_id").limit(n)

    def track_propagation(self, paths: DataFrame) -> DataFrame:
        return self._ends(paths).select("track_id", geo.lon_separation(F.col("a.lon"), F.col("b.lon")).alias("degrees"))

    def group_velocity(self, paths: DataFrame) -> DataFrame:
        hours = float(self.meta.get("dt_hours", self.meta.get("cadence_hours", 6)))
        metres = geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) * 1000
        return self._ends(paths).select("track_id", F.try_divide(metres, (F.col("b.time") - F.col("a.time")) * hours * 3600).alias("m_per_s"))

    def tracks_through(self, paths: DataFrame, region: tuple) -> DataFrame:
        inside = self.tables["track_nodes"].filter(self.inside(region, "lon", "lat")).select("key")
        return paths.join(inside, "key", "left_semi").select("track_id").distinct()

    def provenance(self, paths: DataFrame) -> DataFrame:
        """The first vertex of each track."""
        return paths.filter("pos = 0").select("track_id", "key")

    def drift(self, paths: DataFrame, most: float = 40.0) -> DataFrame:
        """Net eastward degrees of each track; minus infinity if a step is longer than ``most``."""
        v = paths.join(self.tables["track_nodes"], "key")
        step = geo.signed_east(F.lag("lon").over(Window.partitionBy("track_id").orderBy("pos")), F.col("lon"))
        return v.withColumn("step", step).groupBy("track_id").agg(F.when(F.max(F.abs("step")) > most, float("-inf")).otherwise(F.coalesce(F.sum("step"), F.lit(0.0))).alias("drift"))
