"""The field as a triangulated surface: clips with cut points, its graph of edges, and what lies on it.

A surface is a table of triangles, each with its three vertices: id, lat, lon and v. A clip keeps what reaches a value; it
cuts the triangles that cross it and puts new vertices where edges cross, named by the edge, so that triangles that share
an edge share its cut. All of that is done row by row. Regions, shortest ways and clusters are found in one frame at a
time, on arrays of the clipped triangles' edges."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..sources.staging import spread

VERTEX = "struct<id:string,lat:double,lon:double,v:double>"


def triangles(field: DataFrame, n_lon: int) -> DataFrame:
    """(time, a, b, c): each cell of four neighbouring points (around the seam too) as two triangles."""
    point = F.struct((F.col("lat_idx") * n_lon + F.col("lon_idx")).cast("string").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("lat", "lon", "v")))
    rows = spread(field, "time").select("time", "lat_idx", "lon_idx", point.alias("p"))
    # the first column comes a second time, beyond the last
    at = F.explode(F.when(F.col("lon_idx") == 0, F.array(F.lit(0), F.lit(n_lon))).otherwise(F.array("lon_idx")))
    wide = rows.withColumn("at", at)
    next_ = lambda c, by, along: F.lead(F.struct(F.col(c).alias("x"), F.col(along).alias("i"))).over(Window.partitionBy("time", by).orderBy(along))
    pairs = wide.withColumn("e", next_("p", "lat_idx", "at")).filter((F.col("e.i") == F.col("at") + 1) & (F.col("at") < n_lon))
    pairs = pairs.select("time", "lat_idx", "at", F.struct("p", F.col("e.x").alias("e")).alias("low"))
    quads = pairs.withColumn("n", next_("low", "at", "lat_idx")).filter(F.col("n.i") == F.col("lat_idx") + 1)
    corner = lambda a, b, c: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"))
    both = F.explode(F.array(corner("low.p", "low.e", "n.x.e"), corner("low.p", "n.x.e", "n.x.p")))
    return quads.select("time", both.alias("t")).select("time", "t.*")


def _cut(lo: Column, hi: Column, f, value: Column, t: Column) -> Column:
    """Where f crosses ``value`` between two vertices, ``t`` of the way from the one of smaller id; a vertex where it lies on
    one."""
    on = lambda c: lo[c] + t * (hi[c] - lo[c])
    lon = F.pmod(lo["lon"] + t * geo.signed_east(lo["lon"], hi["lon"]), F.lit(360.0))
    new = F.struct(F.concat(F.lit("("), lo["id"], F.lit("|"), hi["id"], F.lit(")")).alias("id"), on("lat").alias("lat"), lon.alias("lon"), on("v").alias("v"))
    return F.when(f(lo) == value, lo).when(f(hi) == value, hi).otherwise(new)


def clip(surface: DataFrame, f, value) -> DataFrame:
    """The part of a surface (a, b, c, ...) where ``f`` of a vertex is at least ``value`` (a number or a column)."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    keys = [c for c in surface.columns if c not in ("a", "b", "c")]
    inside = [(f(F.col(x)) >= value).cast("int") for x in "abc"]
    rows = surface.select("*", value.alias("value"), sum(inside[1:], inside[0]).alias("inside"), *(i.alias(f"in_{x}") for i, x in zip(inside, "abc", strict=True))).filter("inside > 0")
    # the vertex that differs from the other two comes first
    odd = F.when(F.col("inside") == 1, F.lit(1)).otherwise(F.lit(0))
    turn = lambda x, y, z: F.when(F.col("in_a") == odd, F.col(x)).when(F.col("in_b") == odd, F.col(y)).otherwise(F.col(z))
    rows = rows.select(*keys, "value", "inside", "a", "b", "c", turn("a", "b", "c").alias("p"), turn("b", "c", "a").alias("q"), turn("c", "a", "b").alias("r"))
    cuts = F.col("inside") < 3
    # step by step, as one expression of all this is more code than the JVM compiles
    first = {x: F.col("p.id") < F.col(f"{x}.id") for x in "qr"}
    rows = rows.select("*", *(F.when(first[x], F.col(y)).otherwise(F.col(z)).alias(f"{n}_{x}") for x in "qr" for n, y, z in (("lo", "p", x), ("hi", x, "p"))))
    way = lambda x: F.try_divide(F.col("value") - f(F.col(f"lo_{x}")), f(F.col(f"hi_{x}")) - f(F.col(f"lo_{x}")))
    rows = rows.select("*", *(F.when(cuts, way(x)).alias(f"t_{x}") for x in "qr"))
    rows = rows.select("*", *(F.when(cuts, _cut(F.col(f"lo_{x}"), F.col(f"hi_{x}"), f, F.col("value"), F.col(f"t_{x}"))).alias(f"p{x}") for x in "qr"))
    t = lambda *x: F.struct(*(F.col(c).cast(VERTEX).alias(n) for c, n in zip(x, "abc", strict=True)))
    parts = F.when(F.col("inside") == 3, F.array(t("a", "b", "c"))).when(F.col("inside") == 1, F.array(t("p", "pq", "pr"))).otherwise(F.array(t("pq", "q", "r"), t("pq", "r", "pr")))
    out = rows.select(*keys, F.explode(parts).alias("t")).select(*keys, "t.*")
    # what a cut through a vertex leaves without area
    return out.filter((F.col("a.id") != F.col("b.id")) & (F.col("b.id") != F.col("c.id")) & (F.col("a.id") != F.col("c.id")))


def corners(surface: DataFrame) -> DataFrame:
    """The vertices of each triangle, with its keys; a vertex as often as triangles have it."""
    keys = [c for c in surface.columns if c not in ("a", "b", "c")]
    return surface.select(*keys, F.explode(F.array("a", "b", "c")).alias("p")).select(*keys, "p.*")


def edges(surface: DataFrame) -> DataFrame:
    """Each edge of the triangles once: keys, a, b (ids, the smaller first) and km, straight through the sphere."""
    keys = [c for c in surface.columns if c not in ("a", "b", "c")]
    pair = lambda x, y: F.struct(F.when(F.col(x)["id"] < F.col(y)["id"], F.col(x)).otherwise(F.col(y)).alias("a"), F.when(F.col(x)["id"] < F.col(y)["id"], F.col(y)).otherwise(F.col(x)).alias("b"))
    rows = surface.select(*keys, F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("a", "c"))).alias("e"))
    half = lambda e: F.sin(geo.haversine_km(e["a.lat"], e["a.lon"], e["b.lat"], e["b.lon"]) / (2 * geo.EARTH_KM)) * (2 * geo.EARTH_KM)
    e = {f"{x}.{c}": F.col(f"e.{x}.{c}") for x in "ab" for c in ("lat", "lon")}
    rows = rows.select(*keys, F.col("e.a.id").alias("a"), F.col("e.b.id").alias("b"), half(e).alias("km"))
    return rows.groupBy(*keys, "a", "b").agg(F.min("km").alias("km"))


def parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n vertices joined by edges a, b: labels fall along edges, and jump to
    their labels' labels, until none does."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        # a component's former name takes the lower one too
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class Graph:
    """A surface's vertices (names) and edges in rows of neighbours."""

    def __init__(self, pdf: pd.DataFrame):
        """From triangles: columns a, b, c (names) and lat, lon and v of each."""
        flat = np.concatenate([pdf[f"{x}_id"].to_numpy(object) for x in "abc"])
        codes, names = pd.factorize(flat, sort=True)
        self.names, tri = np.asarray(names, object), codes.reshape(3, -1)
        first = np.zeros(len(names), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        self.lat, self.lon, self.v = (np.concatenate([pdf[f"{x}_{c}"].to_numpy(float) for x in "abc"])[first] for c in ("lat", "lon", "v"))
        pairs = np.sort(np.concatenate([tri[[0, 1]], tri[[1, 2]], tri[[0, 2]]], axis=1), axis=0)
        pairs = np.unique(pairs, axis=1) if pairs.size else pairs
        self.a, self.b = pairs
        self.region = parts(len(names), self.a, self.b)

    def neighbours(self):
        """Where each vertex's neighbours begin, who they are, and how far (km, straight through the sphere)."""
        if not hasattr(self, "_rows"):
            lat, lon = np.radians(self.lat), np.radians(self.lon)
            at = geo.EARTH_KM * np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
            km = np.sqrt(((at[:, self.a] - at[:, self.b]) ** 2).sum(axis=0))
            src, dst, km = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a]), np.concatenate([km, km])
            order = np.argsort(src, kind="stable")
            self._rows = np.searchsorted(src[order], np.arange(len(self.names) + 1)).tolist(), dst[order].tolist(), km[order].tolist()
        return self._rows

    def ways(self, source: int, targets: set, reach: float) -> dict:
        """{target: (km, least |v| on the shortest way, both ends included)} within ``reach`` of a source."""
        begin, to, km = self.neighbours()
        size = np.abs(self.v)
        best, low, done, out, left = {source: 0.0}, {source: float(size[source])}, set(), {}, set(targets) - {source}
        heap = [(0.0, source)]
        while heap and left:
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            if n in left:
                left.remove(n)
                out[n] = (d, low[n])
            for i in range(begin[n], begin[n + 1]):
                x, far = to[i], d + km[i]
                if far <= reach and far < best.get(x, np.inf):
                    best[x], low[x] = far, min(low[n], float(size[x]))
                    heapq.heappush(heap, (far, x))
        return out


_FLAT = [f"{x}_{c}" for x in "abc" for c in ("id", "lat", "lon", "v")]


def flat(surface: DataFrame) -> DataFrame:
    """Vertices' fields as columns, as the functions below take them."""
    keys = [c for c in surface.columns if c not in ("a", "b", "c")]
    return surface.select(*keys, *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "abc" for c in ("id", "lat", "lon", "v")))


def cluster(surface: DataFrame, extrema: DataFrame, *, eps_km: float = 3000.0, scale_km: float = 2000.0) -> DataFrame:
    """(time, cell, region, cluster) for extrema (time, sign, cell) on a clipped surface (time, sign, a, b, c): clusters hold
    those of a region that ways join whose length, with ``scale_km`` for each unit of relative descent on it from the
    weaker end, is at most ``eps_km`` (every point counts as a core point). Regions and clusters are named by their least
    cell and extremum. Extrema on no triangle are left out."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"time": [], "cell": [], "region": [], "cluster": []}).astype({"time": "int32", "cell": "int64", "region": "int64", "cluster": "int64"})
        if not len(left) or not len(right):
            return empty
        g = Graph(left)
        at = {int(n): i for i, n in enumerate(g.names) if n.isdigit()}
        own = [(int(c), at[int(c)]) for c in sorted(right["cell"]) if int(c) in at]
        if not own:
            return empty
        cells = np.array([int(n) if n.isdigit() else np.iinfo(np.int64).max for n in g.names])
        least = np.full(len(g.names), np.iinfo(np.int64).max)
        np.minimum.at(least, g.region, cells)
        pairs = []
        for region in {g.region[i] for _, i in own}:
            here = [i for _, i in own if g.region[i] == region]
            for k, s in enumerate(here[:-1]):
                for x, (km, low) in g.ways(s, set(here[k + 1 :]), eps_km).items():
                    ref = min(abs(g.v[s]), abs(g.v[x]))
                    if km + (max(0.0, (ref - low) / ref) if ref > 0 else 0.0) * scale_km <= eps_km:
                        pairs.append((s, x))
        number = {i: k for k, (_, i) in enumerate(own)}
        a, b = (np.array([number[p[j]] for p in pairs], np.int64) for j in (0, 1))
        name = parts(len(own), a, b)
        return pd.DataFrame({"time": np.int32(left["time"].iloc[0]), "cell": [c for c, _ in own], "region": [least[g.region[i]] for _, i in own], "cluster": [own[k][0] for k in name]})

    right = extrema.select(F.col("time").alias("on_time"), F.col("sign").alias("on_sign"), "cell")
    return spread(flat(surface), "time", "sign").groupBy("time", "sign").cogroup(spread(right, "on_time", "on_sign").groupBy("on_time", "on_sign")).applyInPandas(run, "time int, cell long, region long, cluster long")


def around(surface: DataFrame, nodes: DataFrame) -> DataFrame:
    """(time, rwp_id, node, id, lat, lon, v): all vertices of the region that a packet's node (time, rwp_id, sign, node, cell)
    lies on, of that packet's clipped surface (time, rwp_id, sign, a, b, c)."""
    keys = ["time", "rwp_id", "sign"]
    names = ["time", "rwp_id", "node", "id", "lat", "lon", "v"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            g = Graph(left)
            at = {n: i for i, n in enumerate(g.names)}
            for node, cell in zip(right["node"], right["cell"], strict=True):
                if (i := at.get(str(int(cell)))) is not None:
                    here = np.flatnonzero(g.region == g.region[i])
                    out.append(pd.DataFrame({"time": np.int32(left["time"].iloc[0]), "rwp_id": left["rwp_id"].iloc[0], "node": node, "id": g.names[here], "lat": g.lat[here], "lon": g.lon[here], "v": g.v[here]}))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    # names of its own, as both sides may come from one table
    right = spread(nodes.select(*(F.col(k).alias(f"on_{k}") for k in keys), "node", "cell"), *(f"on_{k}" for k in keys))
    return spread(flat(surface), *keys).groupBy(*keys).cogroup(right.groupBy(*(f"on_{k}" for k in keys))).applyInPandas(run, "time int, rwp_id long, node long, id string, lat double, lon double, v double")
