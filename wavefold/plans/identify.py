"""From a gridded field to packets, their rasters, tracks and features, time step by time step, as one Spark plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions import geo
from ..operators import association, compare, features, frames, routes, spectral, stencil, surface, tracking
from ..sources.staging import save
from .catalogue import packet_summary, path_edges


def _band(c: Config, lat: str = "lat") -> Column:
    """A bound of 0 or None bounds nothing."""
    out = F.lit(True)
    if c.min_latitude:
        out = out & (F.col(lat) >= c.min_latitude)
    if c.max_latitude:
        out = out & (F.col(lat) <= c.max_latitude)
    return out


def _with_cell(field: DataFrame, n_lon: int) -> DataFrame:
    return field.withColumn("cell", (F.col("lat_idx") * n_lon + F.col("lon_idx")).cast("long"))


def regions(field: DataFrame, clip: float, n_lon: int) -> DataFrame:
    """(time, cell, region): connected cells of one sign and at least ``clip`` in magnitude."""
    strong = field.filter(F.abs("v") >= clip)
    return frames.label_regions(strong.select("time", F.signum("v").cast("int").alias("sign"), "lat_idx", "lon_idx"), n_lon)


def extrema_clusters(field: DataFrame, c: Config, n_lon: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clustered maxima and minima: (time, id, lat, lon, v, region, cell), one row for each cluster, at its strongest member;
    and the members (time, id, lat, lon, v)."""
    mesh = surface.triangles(field, n_lon)
    reach = field.agg(F.min("lat"), F.max("lat")).first()
    for bound, sign, end in ((c.min_latitude, 1, reach[0]), (c.max_latitude, -1, reach[1])):
        # a field that ends inside the band needs no cut there
        if bound and end is not None and end * sign < bound * sign:
            mesh = surface.clip(mesh, lambda p, s=sign: p["lat"] * s, bound * sign)
    signed = mesh.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    strong = surface.clip(signed, lambda p: p["v"] * F.col("sign"), c.clip_value)
    high, low = (_with_cell(f(field, c.extrema_threshold), n_lon) for f in (stencil.local_maxima, stencil.local_minima))
    points = save(high.unionByName(low).filter(_band(c)).select("time", F.signum("v").cast("int").alias("sign"), "cell", "lat", "lon", "v"), "extrema")
    named = surface.cluster(strong, points, eps_km=c.cluster_max_eps_km, scale_km=c.penalty_length_scale_km)
    clustered = save(points.drop("sign").join(named, ["time", "cell"]), "clustered")
    best = F.max_by(F.struct("lat", "lon", "v", "region", "cell"), F.struct(F.abs("v"), -F.col("cell")))
    one = save(clustered.groupBy("time", F.col("cluster").alias("id")).agg(best.alias("x")).select("time", "id", "x.*"), "clusters")
    return one.filter("v > 0"), one.filter("v < 0"), clustered.select("time", F.col("cluster").alias("id"), "lat", "lon", "v")


def graph(field: DataFrame, high: DataFrame, low: DataFrame, c: Config) -> DataFrame:
    """The pruned association graph: (time, max_id, min_id, ..., weight)."""
    pairs = association.associate(stencil.zero_contour(field), high, low)
    edges = association.prune_nodes(association.weigh(pairs, high, low), c.node_pruning_threshold)
    return save(association.prune_edges(edges, c.edge_pruning_threshold, c.max_edge_weight, min_dlon=c.min_longitude_separation, max_aspect=c.max_aspect_ratio), "graph")


def packet_paths(g: DataFrame, c: Config) -> DataFrame:
    """(time, rwp_id, pos, node): the packets of a pruned graph."""
    links = g.select("time", F.col("max_id").alias("a"), F.col("min_id").alias("b"), "weight", "dlon", *(F.col(f"{k}_{x}").alias(f"{x}_{i}") for i, k in (("a", "max"), ("b", "min")) for x in ("lon", "lat")))
    east = geo.is_east("lon_a", "lon_b")
    end = lambda x: (F.when(east, F.col(f"{x}_a")).otherwise(F.col(f"{x}_b")), F.when(east, F.col(f"{x}_b")).otherwise(F.col(f"{x}_a")))
    (lon1, lon2), (lat1, lat2) = end("lon"), end("lat")
    steps = links.select("time", F.when(east, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(east, F.col("b")).otherwise(F.col("a")).alias("dst"), F.col("dlon").alias("arc"), "weight", lon1.alias("lon1"), lat1.alias("lat1"), lon2.alias("lon2"), lat2.alias("lat2"))
    return save(routes.packets(steps, c.lat_gate), "paths")


def packet_paths_at(field: DataFrame, high: DataFrame, low: DataFrame, c: Config, prunings: list[float]) -> DataFrame:
    """(time, rwp_id, pos, node): the packets of the graph pruned at each of the ``prunings``, all in one pass: those of
    the k-th have ids that are k modulo their number."""
    n = len(prunings)
    edges = graph(field, high, low, Config(**vars(c) | {"edge_pruning_threshold": min(prunings)}))
    kept = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(prunings))), lambda x: x["p"] <= F.col("weight"))
    # a frame for each pruning
    runs = edges.withColumn("at", F.explode(kept)).withColumn("time", F.col("time") * n + F.col("at.k")).drop("at")
    paths = packet_paths(runs, c)
    return paths.select(F.floor(F.col("time") / n).cast("int").alias("time"), (F.col("rwp_id") * n + F.pmod("time", F.lit(n))).alias("rwp_id"), "pos", "node")


def footprints(field: DataFrame, on: DataFrame, c: Config, n_lon: int) -> DataFrame:
    """(time, rwp_id, node, id, lat, lon, v, x, y): of each node of a packet of at least a third of its peak, the points of
    the surface that is clipped at that third and connected with the node, inside the band of latitude: those of the grid
    and those where edges are cut. ``on``: time, rwp_id, node, cell, v."""
    peaks = on.groupBy("time", "rwp_id").agg((F.max(F.abs("v")) / 3).alias("least"))
    own = save(on.join(peaks, ["time", "rwp_id"]).filter(F.abs("v") >= F.col("least")).select("time", "rwp_id", "least", F.signum("v").cast("int").alias("sign"), "node", "cell"), "own")
    # a frame's triangles meet its packets
    size = F.greatest(*(F.col(f"{x}.v") * F.col("sign") for x in "abc"))
    mesh = surface.triangles(field, n_lon).join(own.select("time", "rwp_id", "sign", "least").distinct(), "time").filter(size >= F.col("least"))
    strong = surface.clip(mesh, lambda p: p["v"] * F.col("sign"), F.col("least"))
    x, y = geo.to_stereographic("lat", "lon", c.hemisphere)
    return save(surface.around(strong, own).filter(_band(c)).select("time", "rwp_id", "node", "id", "lat", "lon", "v", x.alias("x"), y.alias("y")), "footprints")


def identify(field: DataFrame, c: Config, *, n_lon: int | None = None, pixels: int = 512) -> dict[str, DataFrame]:
    """The tables nodes, edges, rwps and samples, rasters labels and energies (sparse pixels), and shapes, the packets'
    footprints with their areas (square metres), polygons and holes."""
    if c.hull_method not in ("per_node", "convex", "concave"):
        raise ValueError(f"hull_method {c.hull_method!r} is not one of per_node, convex and concave")
    n_lon = n_lon or field.agg(F.max("lon_idx")).first()[0] + 1
    high, low, _ = extrema_clusters(field, c, n_lon)
    both = high.unionByName(low)
    chosen = packet_paths(graph(field, high, low, c), c)
    on = save(chosen.join(both.withColumnRenamed("id", "node"), ["time", "node"]), "on")
    kind = F.when(F.col("v") > 0, "max").otherwise("min")
    nodes = on.select(F.col("time").cast("long").alias("time"), "rwp_id", geo.node_id(kind, F.col("node")).alias("node_id"), kind.alias("node_type"), "lon", "lat", F.col("v").alias("scalar"), F.col("node").alias("cluster_id"), F.col("region").alias("region_id"), "pos")
    points = footprints(field, on, c, n_lon)
    together = points.withColumn("node", F.lit(0).cast("long"))
    hulls = save(frames.concave_hulls(together) if c.hull_method == "concave" else frames.node_hulls(points if c.hull_method == "per_node" else together), "hulls")
    # pixels are found for convex rings
    convex = hulls.select("time", "rwp_id", "node", F.explode("parts").alias("ring")) if c.hull_method == "concave" else hulls
    labels = frames.rasterise(convex, pixels)
    nx, ny = geo.to_stereographic("lat", "lon", c.hemisphere)
    energies = frames.energy_disks(nodes.select("time", "rwp_id", "pos", "scalar", nx.alias("x"), ny.alias("y")), pixels, radius_m=c.energy_radius_km * 1000)

    lon, lat = geo.weighted_centroid("lon", "lat", "v")
    centre = points.groupBy(F.col("time").cast("long").alias("time"), "rwp_id").agg(lon.alias("weighted_lon"), lat.alias("weighted_lat"))
    shape = frames.merged(hulls)
    rwps = packet_summary(nodes).drop("weighted_lon", "weighted_lat", "geometry_wkb").join(centre, ["time", "rwp_id"]).join(shape.select("time", "rwp_id", "geometry_wkb"), ["time", "rwp_id"])
    nth = F.row_number().over(Window.partitionBy("time", "rwp_id").orderBy("node", "lat", "lon", "id")) - 1
    samples = points.withColumn("n", nth).filter(F.col("n") % 5 == 0).select(F.col("time").cast("long").alias("time"), "rwp_id", (F.col("n") / 5).cast("long").alias("pt_idx"), "lon", "lat")
    return {"nodes": nodes.drop("pos"), "edges": path_edges(nodes, "pos"), "rwps": rwps, "samples": samples, "labels": labels, "energies": energies, "shapes": shape}


def track(found: dict[str, DataFrame], *, number_steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The catalogue's track_nodes and track_edges (not pruned) of what identify() found, of the first ``number_steps`` steps
    of time. Packets that others cover in the raster are no vertices."""
    cells = found["labels"].join(found["energies"].hint("merge"), ["time", "row", "col"], "left").select(F.col("time").cast("long").alias("time"), "row", "col", "rwp_id", F.coalesce("energy", F.lit(0.0)).alias("energy"))
    if number_steps is not None:
        cells = cells.filter(F.col("time") < number_steps)
    cells = save(cells, "cells")
    places = save(found["rwps"].select("time", "rwp_id", F.col("weighted_lon").alias("lon"), F.col("weighted_lat").alias("lat")), "places")
    seen = cells.select("time", "rwp_id").distinct().join(places, ["time", "rwp_id"])
    return seen.select("time", F.col("rwp_id").alias("feature"), "lon", "lat", geo.key("time", "rwp_id").alias("key")), save(tracking.edges(cells, places), "track_edges")


def tracks(track_edges: DataFrame, c: Config, *, max_km: float | None = None, min_weight: float | None = None) -> DataFrame:
    """Tracks of the pruned graph; a gate that is None is the settings' (whose own None switches it off)."""
    max_km = c.track_pruning_threshold if max_km is None else max_km
    min_weight = c.track_weight_threshold if min_weight is None else min_weight
    return tracking.track_paths(save(tracking.prune(track_edges, max_km, min_weight), "pruned"), save)


def extract_features(field: DataFrame, c: Config, *, threshold: float, fraction: float | None = None, n_lon: int | None = None) -> DataFrame:
    """Clustered extrema of all time steps as features (run, time, id, node_type, lon, lat, scalar, ring, strength) for
    features.track. Extrema of one region share it out by floods from each; ``fraction`` leaves cells of at least that
    part of the peak only, the extremum itself where there are none. Strong ones reach ``threshold``."""
    n_lon = n_lon or field.agg(F.max("lon_idx")).first()[0] + 1
    high, low, _ = extrema_clusters(field, c, n_lon)
    nodes = high.unionByName(low).filter(F.abs("v") >= c.clip_value).select("time", "id", "cell", F.col("lon").alias("node_lon"), F.col("lat").alias("node_lat"), F.col("v").alias("scalar"))
    nodes = save(nodes, "nodes")
    field = _with_cell(field, n_lon)
    named = save(regions(field, c.clip_value, n_lon), "regions")
    live = named.join(nodes, ["time", "cell"]).select("time", "region").distinct()
    seeds = named.join(live, ["time", "region"]).join(nodes.select("time", "cell", F.col("id").alias("seed")), ["time", "cell"], "left")
    owner = save(frames.partition(seeds.select("time", "region", "cell", "seed"), n_lon), "owners")
    cells = field.join(owner, ["time", "cell"]).join(nodes.drop("cell"), (owner["time"] == nodes["time"]) & (F.col("seed") == F.col("id"))).select(owner["time"], "id", "lat", "lon", "v", "scalar")
    if fraction is not None:
        cells = cells.filter(F.when(F.col("scalar") > 0, F.col("v") >= F.col("scalar") / fraction).otherwise(F.col("v") <= F.col("scalar") / fraction))
    bare = nodes.join(cells.select("time", "id").distinct(), ["time", "id"], "left_anti").select("time", "id", F.col("node_lat").alias("lat"), F.col("node_lon").alias("lon"))
    x, y = geo.to_stereographic("lat", "lon", c.hemisphere)
    points = cells.select("time", "id", "lat", "lon").unionByName(bare).select("time", F.lit(0).cast("long").alias("rwp_id"), F.col("id").alias("node"), x.alias("x"), y.alias("y"))
    rings = frames.node_hulls(points).select("time", F.col("node").alias("id"), "ring")
    kind = F.when(F.col("scalar") > 0, "max").otherwise("min")
    return nodes.join(rings, ["time", "id"]).select(F.lit("").alias("run"), F.col("time").cast("long").alias("time"), "id", kind.alias("node_type"), F.col("node_lon").alias("lon"), F.col("node_lat").alias("lat"), "scalar", "ring", geo.strength("scalar", threshold).alias("strength"))


def packet_mask(labels: DataFrame, grid: DataFrame) -> DataFrame:
    """Pixels (time, row, col) of packets inside the band that ``grid`` (row, col, lat) is of."""
    return labels.join(compare.in_band(grid), ["row", "col"]).select("time", "row", "col")


def method_sweep(field: DataFrame, c: Config, *, amplitudes: list[float], prunings: list[float], n_lon: int | None = None, pixels: int = 512, reference: float = 14.0, waves: tuple[int, int] = (3, 11), smooth: int = 1, truncation: int | None = None, band: tuple[float, float] = (20.0, 80.0)) -> DataFrame:
    """How packets of pruned graphs (edge_pruning) and hulls of strong extrema (node_amplitude) agree with the wave
    envelope of at least ``reference``, at each threshold and time step, on one raster in a band of latitude: the columns
    of compare.agreement, for compare.sweep. Extrema, graph and raster are made once for all thresholds; ``smooth`` is the
    width of the envelope's running mean in steps of time, after it is truncated at total wave number ``truncation``."""
    field = save(field, "field")
    n_lon = n_lon or field.agg(F.max("lon_idx")).first()[0] + 1
    grid = save(compare.in_band(compare.pixel_grid(field.sparkSession, pixels, frames.HALF_WIDTH, c.hemisphere), *band), "grid")
    inside = grid.select("row", "col")
    envelope = stencil.envelope(field, *waves, n_lon=n_lon)
    if truncation is not None:
        n_lat = field.agg(F.max("lat_idx")).first()[0] + 1
        envelope = spectral.truncate(envelope, truncation, n_lat=n_lat, n_lon=n_lon, value="envelope")
    if smooth > 1:
        envelope = stencil.running_mean(envelope.withColumnRenamed("envelope", "v"), smooth).withColumnRenamed("v", "envelope")
    seen, cells = compare.envelope_mask(envelope, reference), save(compare.nearest_cells(grid, field), "cells")
    high, low, members = extrema_clusters(field, c, n_lon)
    both = high.unionByName(low)
    x, y = geo.to_stereographic("lat", "lon", c.hemisphere)
    level = both.select("time", F.col("id").alias("node"), F.abs("v").alias("level"))
    points = members.select("time", F.lit(0).cast("long").alias("rwp_id"), F.col("id").alias("node"), x.alias("x"), y.alias("y"))
    strong = frames.touched(frames.node_hulls(points).join(level, ["time", "node"]), pixels).join(inside, ["row", "col"])
    hits = compare.levelled(strong, "node_amplitude", amplitudes)
    on = packet_paths_at(field, high, low, c, prunings).join(both.withColumnRenamed("id", "node"), ["time", "node"])
    hulls = frames.node_hulls(footprints(field, save(on, "on"), c, n_lon))
    at = F.element_at(F.array(*(F.lit(float(p)) for p in prunings)), (F.pmod("rwp_id", F.lit(len(prunings))) + 1).cast("int"))
    hits = hits.unionByName(frames.touched(hulls, pixels).join(inside, ["row", "col"]).select(F.lit("edge_pruning").alias("method"), at.alias("threshold"), "time", "row", "col"))
    runs = [("node_amplitude", float(t), True) for t in amplitudes] + [("edge_pruning", float(t), False) for t in prunings]
    thresholds = field.sparkSession.createDataFrame(runs, "method string, threshold double, suffix boolean")
    return compare.agreement(hits, seen, thresholds, field.select("time"), grid.count(), cells)


def amplitude_mask(field: DataFrame, c: Config, grid: DataFrame, least: float, *, n_lon: int, pixels: int = 512) -> DataFrame:
    """The same of the hulls of the extrema of each cluster of at least ``least``, whether linked or not."""
    high, low, members = extrema_clusters(field, c, n_lon)
    strong = high.unionByName(low).filter(F.abs("v") >= least).select("time", "id")
    x, y = geo.to_stereographic("lat", "lon", c.hemisphere)
    points = members.join(strong, ["time", "id"]).select("time", F.col("id").alias("rwp_id"), F.col("id").alias("node"), x.alias("x"), y.alias("y"))
    return packet_mask(frames.rasterise(frames.node_hulls(points), pixels), grid)
