"""The registered queries over the supplied tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .functions import geo
from .operators import association, compare, frames, spectral, stencil, surface, tracking
from .plans.catalogue import Catalogue, packet_summary, path_edges
from .sources import adapters, field as fields
from .sources.staging import path, save

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles to six places (and no negative zero), as the two engines' sines may differ in the last bit."""
    return df.withColumns({c: F.round(F.col(c), places) + 0.0 for c in columns})


def catalogue(spark: SparkSession, sf_dir: str, **meta) -> Catalogue:
    nodes = adapters.nodes(spark, sf_dir)
    rwps = packet_summary(nodes)
    samples = nodes.filter(F.col("cluster_id") % 5 == 0).select("time", "rwp_id", (F.col("cluster_id") / 5).cast("long").alias("pt_idx"), "lon", "lat")
    places = label_places(spark, sf_dir)
    cells = adapters.cells(spark, sf_dir)
    track_nodes = places.join(cells.select("time", "rwp_id").distinct(), ["time", "rwp_id"]).select("time", F.col("rwp_id").alias("feature"), "lon", "lat", geo.key("time", "rwp_id").alias("key"))
    tables = {"nodes": nodes, "edges": path_edges(nodes), "rwps": rwps, "samples": samples, "track_nodes": track_nodes, "track_edges": tracking.edges(cells, places)}
    return Catalogue(tables, {"dt_hours": 24} | meta)


def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids (time, rwp_id, lon, lat) of the raster's labels."""
    lon, lat = geo.weighted_centroid("lon", "lat", "scalar")
    labelled = adapters.nodes(spark, sf_dir).withColumn("rwp_id", F.col("rwp_id") % 40 + 1)
    return labelled.groupBy("time", "rwp_id").agg(lon.alias("lon"), lat.alias("lat"))


NODES = """nodes AS (
  SELECT time, rwp_id, CASE WHEN node_type = 'max' THEN i ELSE -i - 1 END AS node_id, node_type, lon, lat, scalar, i AS cluster_id, region_id FROM (
    SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS time, user_id AS rwp_id, event_id,
           row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY event_id) - 1 AS i,
           CASE WHEN event_id % 2 = 0 THEN 'max' ELSE 'min' END AS node_type, ((event_id * 37) % 720) / 2.0 AS lon, 20 + ((event_id * 13) % 121) / 2.0 AS lat,
           CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS scalar, event_id % 5 AS region_id FROM events))"""
HAV = "(2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"least(greatest(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2), 0.0), 1.0)"
    return HAV.format(a=a)


def centroid(lon: str, lat: str, v: str) -> tuple[str, str]:
    return f"degrees(atan2(sum({v} * {v} * sin(radians({lon}))), sum({v} * {v} * cos(radians({lon})))))", f"sum({v} * {v} * {lat}) / sum({v} * {v})"


_CLON, _CLAT = centroid("lon", "lat", "scalar")
RWPS = f"""{NODES},
base AS (SELECT time, rwp_id, round({_CLON}, 9) AS weighted_lon, round({_CLAT}, 9) AS weighted_lat, max(abs(scalar)) AS peak_amp, count(*) AS n_nodes FROM nodes GROUP BY time, rwp_id),
ext AS (SELECT a.time, a.rwp_id, max(least(abs(a.lon - b.lon), 360 - abs(a.lon - b.lon))) AS zonal_extent_deg FROM nodes a JOIN nodes b ON a.time = b.time AND a.rwp_id = b.rwp_id GROUP BY a.time, a.rwp_id),
rwps AS (SELECT * FROM base JOIN ext USING (time, rwp_id))"""
FIELD = """field AS (SELECT CAST(event_id // 3600 AS INTEGER) AS time, CAST((event_id % 3600) // 144 AS INTEGER) AS lat_idx, CAST(event_id % 144 AS INTEGER) AS lon_idx,
  20 + ((event_id % 3600) // 144) * 2.5 AS lat, (event_id % 144) * 2.5 AS lon, round((CASE WHEN event_type IN ('click', 'view') THEN value ELSE -value END) / 10, 3) AS v FROM events)"""
CELLS = f"""{NODES}, cells AS (
  SELECT time, row, col, arg_max(rwp_id, event_id) AS rwp_id, arg_max(energy, event_id) AS energy FROM (
    SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS time, CAST((event_id * 7) % 32 AS INTEGER) AS row, CAST(CAST(floor(value) AS BIGINT) % 32 AS INTEGER) AS col,
           user_id % 40 + 1 AS rwp_id, value * value AS energy, event_id FROM events) GROUP BY time, row, col),
places AS (SELECT time, rwp_id % 40 + 1 AS rwp_id, {_CLON} AS lon, {_CLAT} AS lat FROM nodes GROUP BY time, rwp_id % 40 + 1),
energy AS (SELECT time, rwp_id, sum(energy) AS energy FROM cells GROUP BY time, rwp_id),
lap AS (SELECT b.time AS time_to, a.rwp_id AS feat_from, b.rwp_id AS feat_to, sum(sqrt(a.energy * b.energy)) AS overlap
        FROM cells a JOIN cells b ON b.time = a.time + 1 AND a.row = b.row AND a.col = b.col GROUP BY 1, 2, 3 HAVING sum(sqrt(a.energy * b.energy)) > 0),
te AS (SELECT (time_to - 1) || ':' || feat_from AS src, time_to || ':' || feat_to AS dst, time_to - 1 AS time_from, feat_from, time_to, feat_to, overlap / greatest(x.energy, y.energy) AS weight,
              {hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS distance
       FROM lap JOIN energy x ON x.time = time_to - 1 AND x.rwp_id = feat_from JOIN energy y ON y.time = time_to AND y.rwp_id = feat_to
       JOIN places p ON p.time = time_to - 1 AND p.rwp_id = feat_from JOIN places q ON q.time = time_to AND q.rwp_id = feat_to WHERE greatest(x.energy, y.energy) > 0)"""


# fields


@query(f"WITH {FIELD} SELECT * FROM field WHERE lat BETWEEN 25 AND 70 AND time % 2 = 0")
def field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.select(adapters.field(spark, sf_dir), low=25, high=70, every=2)


@query(f"WITH {FIELD} SELECT * FROM field WHERE lat BETWEEN 32.5 AND 45 AND time >= 1 AND time < 20 AND (time - 1) % 3 = 0")
def field_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field written to a store, and a selection read from it."""
    to = path(spark, "store")
    fields.write_store(adapters.field(spark, sf_dir), to, steps=4)
    return fields.read_store(spark, to, low=32.5, high=45, start=1, stop=20, every=3)


@query(f"""WITH {FIELD} SELECT time, lat_idx // 4 AS lat_idx, lon_idx // 4 AS lon_idx, round(avg(lat), 6) AS lat, round(avg(lon) % 360, 6) AS lon, round(avg(v), 8) AS v FROM field
GROUP BY time, lat_idx // 4, lon_idx // 4 HAVING count(*) = 16""")
def field_coarsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.coarsen(adapters.field(spark, sf_dir), 4), "lat", "lon", "v", places=8)


@query(f"""WITH {FIELD}, c AS (SELECT a.time, a.lat_idx, a.lon_idx, (a.v + b.v + c.v + d.v) / 4 AS m FROM field a JOIN field b ON b.time = a.time AND b.lat_idx = a.lat_idx AND b.lon_idx = a.lon_idx + 1
JOIN field c ON c.time = a.time AND c.lat_idx = a.lat_idx + 1 AND c.lon_idx = a.lon_idx JOIN field d ON d.time = a.time AND d.lat_idx = a.lat_idx + 1 AND d.lon_idx = a.lon_idx + 1)
SELECT time, lat_idx, lon_idx, round(63.71 * cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 AS x, round(63.71 * cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 AS y, round(63.71 * sin(radians(lat)), 6) AS z, v, round(m, 6) + 0.0 AS cell_v
FROM field LEFT JOIN c USING (time, lat_idx, lon_idx)""")
def field_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.mesh(adapters.field(spark, sf_dir)), "x", "y", "z", "cell_v")


def _extreme_sql(agg: str, both: str, test: str) -> str:
    return f"""WITH {FIELD}, s AS (SELECT time, max(lon_idx) + 1 AS n_lon, max(lat_idx) + 1 AS n_lat FROM field GROUP BY time),
p AS (SELECT f.*, n_lon, n_lat FROM field f JOIN s USING (time)),
m AS (SELECT a.time, a.lat_idx, a.lon_idx, {agg}(b.v) AS m FROM p a JOIN field b ON b.time = a.time AND abs(b.lat_idx - a.lat_idx) <= 1
      AND (abs(b.lon_idx - a.lon_idx) <= 1 OR abs(b.lon_idx - a.lon_idx) = a.n_lon - 1) GROUP BY 1, 2, 3)
SELECT p.time, p.lat_idx, p.lon_idx, lat, round(360.0 * p.lon_idx / (n_lon - 1), 6) AS lon, v FROM p JOIN m USING (time, lat_idx, lon_idx)
WHERE v = CASE WHEN p.lat_idx IN (0, n_lat - 1) THEN {both}(m, 0) ELSE m END AND {test}"""


@query(_extreme_sql("max", "greatest", "v > 10"))
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.local_maxima(adapters.field(spark, sf_dir), 10.0), "lon")


@query(_extreme_sql("min", "least", "v < -10 AND p.lat_idx > 0"))
def local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.local_minima(adapters.field(spark, sf_dir), 10.0), "lon")


@query(f"""WITH {FIELD}, p AS (SELECT a.time, a.lat, a.lon, a.v, b.lat AS lat2, b.lon AS lon2, b.v AS v2 FROM field a JOIN field b ON b.time = a.time
AND ((b.lat_idx = a.lat_idx AND b.lon_idx = a.lon_idx + 1) OR (b.lat_idx = a.lat_idx + 1 AND b.lon_idx = a.lon_idx)) WHERE (a.v < 0) <> (b.v < 0))
SELECT time, round(lat + v / (v - v2) * (lat2 - lat), 6) AS lat, round(lon + v / (v - v2) * (lon2 - lon), 6) AS lon FROM p""")
def zero_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.zero_contour(adapters.field(spark, sf_dir)), "lat", "lon")


@query(f"""WITH {FIELD}, e AS (SELECT lat_idx, lon_idx, min(time) AS t0, max(time) AS t1 FROM field GROUP BY 1, 2),
s AS (SELECT f.time, f.lat_idx, f.lon_idx, least(greatest(f.time + d, t0), t1) AS at FROM field f JOIN e USING (lat_idx, lon_idx), (VALUES (-2), (-1), (0), (1)) o(d))
SELECT s.time, s.lat_idx, s.lon_idx, round(avg(v), 6) + 0.0 AS v FROM s JOIN field f ON f.time = s.at AND f.lat_idx = s.lat_idx AND f.lon_idx = s.lon_idx GROUP BY 1, 2, 3""")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.running_mean(adapters.field(spark, sf_dir), 4), "v")


@query(f"WITH {FIELD} SELECT time, lon_idx, round(avg(v), 6) + 0.0 AS v FROM field GROUP BY time, lon_idx")
def hovmoller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.hovmoller(adapters.field(spark, sf_dir)), "v")


@query(f"WITH {FIELD} SELECT time, round(quantile_cont(abs(v), 0.99), 6) AS p FROM field GROUP BY time")
def magnitude_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.magnitude_percentile(adapters.field(spark, sf_dir)), "p")


ENVELOPE = f"""{FIELD}, w AS (SELECT time, lat_idx, k, sum(v * cos(2 * pi() * ((k * lon_idx) % 144) / 144)) AS re, sum(-v * sin(2 * pi() * ((k * lon_idx) % 144) / 144)) AS im
FROM field, range(3, 12) r(k) GROUP BY 1, 2, 3),
z AS (SELECT f.time, f.lat_idx, f.lon_idx, lat, sum(re * cos(2 * pi() * ((k * lon_idx) % 144) / 144) - im * sin(2 * pi() * ((k * lon_idx) % 144) / 144)) AS re,
      sum(re * sin(2 * pi() * ((k * lon_idx) % 144) / 144) + im * cos(2 * pi() * ((k * lon_idx) % 144) / 144)) AS im FROM field f JOIN w USING (time, lat_idx) GROUP BY 1, 2, 3, 4),
env AS (SELECT time, lat_idx, lon_idx, lat, 2.0 / 144 * sqrt(re * re + im * im) AS envelope FROM z)"""


@query(f"WITH {ENVELOPE} SELECT time, lat_idx, lon_idx, round(envelope, 6) AS envelope FROM env")
def wave_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.envelope(adapters.field(spark, sf_dir)), "envelope")


#: T21 in SQL: 25 latitudes mirrored to 50 rows, integrals over 72 nodes between the poles.
TRUNCATED = f"""{FIELD},
node AS (SELECT 'fine' AS kind, j, (j + 0.5) * pi() / 72 AS th FROM range(72) r(j) UNION ALL SELECT 'row', i, (24 - i) * pi() / 49 FROM range(25) r(i)),
leg(kind, j, x, m, l, p0, p1) AS (SELECT kind, j, cos(th), m, m, CAST(0 AS DOUBLE), sqrt((2 * m + 1) / 2.0 * exp(coalesce(list_sum(list_transform(range(1, m + 1), lambda k: ln((2 * k - 1) / (2.0 * k)))), 0.0))) * pow(sin(th), m) FROM node, range(22) r(m)
  UNION ALL SELECT kind, j, x, m, l + 1, p1, sqrt((4.0 * (l + 1) * (l + 1) - 1) / ((l + 1) * (l + 1) - m * m)) * (x * p1 - sqrt((l * l - m * m) / (4.0 * l * l - 1 + CASE WHEN l = 0 THEN 2 ELSE 0 END)) * p0) FROM leg WHERE l < 21),
w AS (SELECT j, th, 2.0 / 72 * (1 - 2 * list_sum(list_transform(range(1, 37), lambda k: cos(2 * k * th) / (4 * k * k - 1)))) AS w FROM node WHERE kind = 'fine'),
card AS (SELECT 0 AS odd, a.j AS i, b.j, CASE WHEN a.j = 24 THEN 0.5 ELSE 1 END * 2.0 / 49 * list_sum(list_transform(range(0, 50), lambda k: CASE WHEN k IN (0, 49) THEN 0.5 ELSE 1 END * cos(k * a.th) * cos(k * b.th))) AS c FROM node a, w b WHERE a.kind = 'row'
  UNION ALL SELECT 1, a.j, b.j, 2.0 / 49 * list_sum(list_transform(range(1, 49), lambda k: sin(k * a.th) * sin(k * b.th))) FROM node a, w b WHERE a.kind = 'row'),
z AS (SELECT i, m, l, 2 * sum(w * p1 * c) AS z FROM leg JOIN w USING (j) JOIN card USING (j) WHERE kind = 'fine' AND (l + m) % 2 = 0 AND odd = m % 2 GROUP BY 1, 2, 3),
fourier AS (SELECT time, lat_idx, m, sum(v * cos(2 * pi() * ((m * lon_idx) % 144) / 144)) AS c, sum(v * sin(2 * pi() * ((m * lon_idx) % 144) / 144)) AS s FROM field, range(22) r(m) GROUP BY 1, 2, 3),
harmonic AS (SELECT time, z.m, l, sum(z * c) AS c, sum(z * s) AS s FROM fourier f JOIN z ON z.i = f.lat_idx AND z.m = f.m GROUP BY 1, 2, 3),
back AS (SELECT time, j AS lat_idx, h.m, sum(p1 * c) AS c, sum(p1 * s) AS s FROM harmonic h JOIN leg ON leg.kind = 'row' AND leg.m = h.m AND leg.l = h.l GROUP BY 1, 2, 3),
smooth AS (SELECT f.time, f.lat_idx, f.lon_idx, sum(CASE WHEN m = 0 THEN 1 ELSE 2 END * (c * cos(2 * pi() * ((m * lon_idx) % 144) / 144) + s * sin(2 * pi() * ((m * lon_idx) % 144) / 144))) / 144 AS v
  FROM field f JOIN back USING (time, lat_idx) GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {TRUNCATED} SELECT time, lat_idx, lon_idx, round(v, 6) + 0.0 AS v FROM smooth")
def truncated_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field's harmonics of total wave number up to 21."""
    return rounded(spectral.truncate(adapters.field(spark, sf_dir), 21, n_lat=adapters.NLAT, n_lon=adapters.NLON), "v")


# crests and troughs as a graph


def _extrema(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = adapters.field(spark, sf_dir)
    number = (F.col("lat_idx") * adapters.NLON + F.col("lon_idx")).cast("long").alias("id")
    return tuple(x.select("time", number, "lat", "lon", "v") for x in (stencil.local_maxima(f, 20.0), stencil.local_minima(f, 20.0)))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = map(save, _extrema(spark, sf_dir))
    pairs = association.associate(stencil.zero_contour(adapters.field(spark, sf_dir)), high, low)
    return association.weigh(pairs, high, low)


def _extrema_cte(name: str, agg: str, both: str, test: str) -> str:
    return f"""{name} AS (SELECT p.time, p.lat_idx * 144 + p.lon_idx AS id, lat, coalesce(360.0 * p.lon_idx / nullif(n_lon - 1, 0), 0) AS lon, v FROM p JOIN (
  SELECT a.time, a.lat_idx, a.lon_idx, {agg}(b.v) AS m FROM p a JOIN field b ON b.time = a.time AND abs(b.lat_idx - a.lat_idx) <= 1 AND (abs(b.lon_idx - a.lon_idx) <= 1 OR abs(b.lon_idx - a.lon_idx) = a.n_lon - 1) GROUP BY 1, 2, 3) m
  USING (time, lat_idx, lon_idx) WHERE v = CASE WHEN p.lat_idx IN (0, n_lat - 1) THEN {both}(m, 0) ELSE m END AND {test})"""


def _nearest_cte(name: str, of: str) -> str:
    xyz = lambda t: (f"cos(radians({t}.lat)) * cos(radians({t}.lon))", f"cos(radians({t}.lat)) * sin(radians({t}.lon))", f"sin(radians({t}.lat))")
    d = " + ".join(f"pow({a} - {b}, 2)" for a, b in zip(xyz("z"), xyz("e"), strict=True))
    return f"{name} AS (SELECT time, lat, lon, id FROM (SELECT z.time, z.lat, z.lon, e.id, row_number() OVER (PARTITION BY z.time, z.lat, z.lon ORDER BY {d}, e.id) AS r FROM z JOIN {of} e USING (time)) WHERE r = 1)"


_ENDS = ("h.lat", "h.lon", "l.lat", "l.lon")
GRAPH = f"""{FIELD}, p AS (SELECT f.*, n_lon, n_lat FROM field f JOIN (SELECT time, max(lon_idx) + 1 AS n_lon, max(lat_idx) + 1 AS n_lat FROM field GROUP BY time) USING (time)),
{_extrema_cte('hi', 'max', 'greatest', 'v > 20')}, {_extrema_cte('lo', 'min', 'least', 'v < -20 AND p.lat_idx > 0')},
z AS (SELECT DISTINCT a.time, a.lat + a.v / (a.v - b.v) * (b.lat - a.lat) AS lat, a.lon + a.v / (a.v - b.v) * (b.lon - a.lon) AS lon FROM field a JOIN field b ON b.time = a.time
  AND ((b.lat_idx = a.lat_idx AND b.lon_idx = a.lon_idx + 1) OR (b.lat_idx = a.lat_idx + 1 AND b.lon_idx = a.lon_idx)) WHERE (a.v < 0) <> (b.v < 0)),
{_nearest_cte('zh', 'hi')}, {_nearest_cte('zl', 'lo')},
pr AS (SELECT DISTINCT zh.time, zh.id AS max_id, zl.id AS min_id FROM zh JOIN zl USING (time, lat, lon)),
w AS (SELECT pr.*, h.lat AS max_lat, h.lon AS max_lon, h.v AS max_v, l.lat AS min_lat, l.lon AS min_lon, l.v AS min_v, {hav(*_ENDS)} AS distance, least(abs(h.lon - l.lon) % 360, 360 - abs(h.lon - l.lon) % 360) AS dlon, abs(h.lat - l.lat) AS dlat
  FROM pr JOIN hi h ON h.time = pr.time AND h.id = max_id JOIN lo l ON l.time = pr.time AND l.id = min_id),
g AS (SELECT * EXCLUDE (dlat), (max_v - min_v) / greatest(distance, 1e-6) * dlon / greatest(sqrt(dlon * dlon + dlat * dlat), 1e-6) AS weight, dlat / greatest(dlon, 1e-6) AS aspect FROM w)"""


@query(f"""WITH {GRAPH} SELECT time, CAST(max_id AS BIGINT) AS max_id, CAST(min_id AS BIGINT) AS min_id, max_lat, round(max_lon, 6) AS max_lon, max_v, min_lat, round(min_lon, 6) AS min_lon, min_v,
round(distance, 6) AS distance, round(weight, 6) AS weight, round(dlon, 6) AS dlon, round(aspect, 6) AS aspect FROM g""")
def association_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_edges(spark, sf_dir), "distance", "weight", "dlon", "aspect", "max_lon", "min_lon")


@query(f"""WITH {GRAPH} SELECT time, count(*) AS n_edges, round(avg(distance), 6) AS mean_km, round(quantile_cont(distance, 0.5), 6) AS median_km, round(max(distance), 6) AS max_km FROM g
WHERE least(max_v, -min_v) BETWEEN 20 AND 100 AND dlon > 6 AND aspect <= 1.5 AND weight BETWEEN 3e-5 AND 1 GROUP BY time""")
def pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = association.prune_edges(association.prune_nodes(_edges(spark, sf_dir), 20.0), 3e-5, 1.0)
    return rounded(association.length_stats(kept), "mean_km", "median_km", "max_km")


@query(f"""WITH {NODES}, b AS (SELECT time, region_id, arg_min(lon, rwp_id * 1000 + cluster_id) AS base FROM nodes GROUP BY 1, 2),
s AS (SELECT n.*, base, ((lon - base + 180) % 360 + 360) % 360 - 180 AS shift FROM nodes n JOIN b USING (time, region_id)),
g AS (SELECT time, region_id, count(*) AS n, max(abs(scalar)) AS peak, min(base) AS base, sum(abs(scalar) * shift) / sum(abs(scalar)) AS shift, sum(abs(scalar) * lat) / sum(abs(scalar)) AS lat FROM s GROUP BY 1, 2)
SELECT time, region_id, n, peak, round(((base + shift) % 360 + 360) % 360, 6) AS lon, round(lat, 6) AS lat FROM g""")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = adapters.nodes(spark, sf_dir).withColumn("id", F.col("rwp_id") * 1000 + F.col("cluster_id"))
    return rounded(association.summarise_clusters(points, ["time", "region_id"]), "lon", "lat").drop("strongest")


@query(f"""WITH {NODES}, p AS (SELECT a.time, a.rwp_id, a.node_id, a.lon AS lon1, a.lat AS lat1, a.scalar AS s1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(scalar) OVER w AS s2 FROM nodes a WINDOW w AS (PARTITION BY time, rwp_id ORDER BY cluster_id)),
q AS (SELECT *, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS km, least(abs(lon1 - lon2), 360 - abs(lon1 - lon2)) AS sep, abs(lat1 - lat2) AS dlat FROM p WHERE lon2 IS NOT NULL)
SELECT time, rwp_id, node_id, round(km, 6) AS km, CASE WHEN abs(lon2 - lon1) > 180 THEN lon1 - lon2 ELSE lon2 - lon1 END > 0 AS east, sep, ((lon2 - lon1 + 180) % 360 + 360) % 360 - 180 AS signed,
round((greatest(s1, s2) - least(s1, s2)) / greatest(km, 1e-6) * sep / greatest(sqrt(sep * sep + dlat * dlat), 1e-6), 6) AS weight, round(dlat / greatest(sep, 1e-6), 6) AS aspect,
round(6371.0 * radians(sep) * cos(radians((lat1 + lat2) / 2)), 6) AS zonal_km, CASE WHEN abs(s1) >= 100 THEN 'strong' ELSE 'weak' END AS strength, floor(lon1 / 7.5) * 7.5 AS lon_bin FROM q""")
def node_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("time", "rwp_id").orderBy("cluster_id")
    n = adapters.nodes(spark, sf_dir).select("time", "rwp_id", "node_id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col("scalar").alias("s1"), *(F.lead(c).over(w).alias(d) for c, d in (("lon", "lon2"), ("lat", "lat2"), ("scalar", "s2")))).filter("lon2 IS NOT NULL")
    ends = ("lat1", "lon1", "lat2", "lon2")
    out = n.select("time", "rwp_id", "node_id", geo.haversine_km(*ends).alias("km"), geo.is_east("lon1", "lon2").alias("east"), geo.lon_separation("lon1", "lon2").alias("sep"), geo.signed_east("lon1", "lon2").alias("signed"), geo.edge_weight(F.greatest("s1", "s2"), F.least("s1", "s2"), *ends).alias("weight"), geo.aspect_ratio(*ends).alias("aspect"), geo.lon_separation_km(*ends).alias("zonal_km"), geo.strength("s1", 100).alias("strength"), geo.grid_bin("lon1", 7.5).alias("lon_bin"))
    return rounded(out, "km", "weight", "aspect", "zonal_km")


@query(f"""WITH {NODES}, t AS (SELECT time, rwp_id, node_id, lat, lon, 0.0818191908426215 AS e, radians(lat) AS phi FROM nodes),
u AS (SELECT *, tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2) * 2 * 6378137.0 / sqrt(pow(1 + e, 1 + e) * pow(1 - e, 1 - e)) AS rho FROM t)
SELECT time, rwp_id, node_id, round(rho * sin(radians(lon)), 3) + 0.0 AS x, round(-rho * cos(radians(lon)), 3) + 0.0 AS y, round(lat, 6) AS lat, round(lon, 6) % 360 AS lon FROM u""")
def stereographic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.to_stereographic("lat", "lon")
    p = adapters.nodes(spark, sf_dir).select("time", "rwp_id", "node_id", x.alias("x"), y.alias("y"))
    lat, lon = geo.from_stereographic("x", "y")
    back = p.select("time", "rwp_id", "node_id", "x", "y", lat.alias("lat"), F.pmod(F.round(lon, 6), F.lit(360.0)).alias("lon"))
    return rounded(rounded(back, "x", "y", places=3), "lat", "lon")


# the catalogue


@query(f"WITH {RWPS} SELECT time, rwp_id, round(weighted_lon, 6) AS weighted_lon, round(weighted_lat, 6) AS weighted_lat, peak_amp, n_nodes, zonal_extent_deg FROM rwps")
def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalogue(spark, sf_dir).rwps().drop("geometry_wkb"), "weighted_lon", "weighted_lat")


@query(f"WITH {NODES} SELECT time, rwp_id, node_id AS src_node_id, nxt AS dst_node_id FROM (SELECT *, lead(node_id) OVER (PARTITION BY time, rwp_id ORDER BY cluster_id) AS nxt FROM nodes) WHERE nxt IS NOT NULL")
def path_edges_of_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).edges()


@query(f"WITH {NODES} SELECT time, rwp_id, node_id AS src_node_id, nxt AS dst_node_id FROM (SELECT *, lead(node_id) OVER (PARTITION BY time, rwp_id ORDER BY cluster_id) AS nxt FROM nodes) WHERE nxt IS NOT NULL AND time = 3")
def path_edges_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).filter(time=3).edges()


@query(f"WITH {NODES} SELECT time, rwp_id, cluster_id // 5 AS pt_idx, lon, lat FROM nodes WHERE cluster_id % 5 = 0 AND lon BETWEEN 30 AND 200 AND lat BETWEEN 30 AND 70")
def samples_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).filter(region=(30, 200, 30, 70)).samples()


@query(f"WITH {NODES} SELECT * FROM nodes WHERE time = 5 AND lon BETWEEN 30 AND 200 AND lat BETWEEN 30 AND 70")
def nodes_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).filter(time=4).filter(time=5, region=(30, 200, 30, 70), unknown=1).nodes()


@query(f"WITH {RWPS} SELECT time, rwp_id, peak_amp, zonal_extent_deg FROM rwps WHERE peak_amp >= 100 AND weighted_lon BETWEEN -90 AND 90 AND weighted_lat BETWEEN 30 AND 70")
def packets_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir).filter(peak_amp_min=100)
    return c.rwps_in((-90, 90, 30, 70)).select("time", "rwp_id", "peak_amp", "zonal_extent_deg")


@query(f"WITH {RWPS} SELECT time, rwp_id, peak_amp FROM rwps")
def amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).amplitudes()


@query(f"WITH {RWPS} SELECT time, rwp_id, zonal_extent_deg FROM rwps")
def zonal_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).zonal_extent()


@query(f"WITH {NODES}, g AS (SELECT time, rwp_id, avg(gap) AS gap FROM (SELECT *, lon - lag(lon) OVER (PARTITION BY time, rwp_id ORDER BY lon) AS gap FROM nodes) GROUP BY 1, 2) SELECT time, rwp_id, round(180 / nullif(gap, 0), 6) AS wavenumber FROM g")
def implied_wavenumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalogue(spark, sf_dir).implied_wavenumber(), "wavenumber")


@query(f"""WITH {RWPS}, e AS (SELECT min(peak_amp) AS lo, max(peak_amp) AS hi, count(*) AS n FROM rwps), b AS (SELECT i, lo + (hi - lo) * i / 20 AS l, lo + (hi - lo) * (i + 1) / 20 AS r, n FROM e, range(20) t(i))
SELECT round(l, 6) AS left, round(r, 6) AS right, round((SELECT count(*) FROM rwps WHERE peak_amp >= l AND (peak_amp < r OR i = 19 AND peak_amp <= r + 1e-9)) / (n * (r - l)), 6) AS density FROM b""")
def amplitude_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalogue(spark, sf_dir).amplitude_pdf(20), "left", "right", "density")


@query(f"WITH {RWPS} SELECT time, count(*) AS n FROM rwps GROUP BY time")
def cycle_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).seasonal_cycle()


@query(f"WITH {RWPS} SELECT CAST(time // 10 AS BIGINT) AS month, count(*) AS n FROM rwps GROUP BY 1")
def seasonal_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir)
    return c.seasonal_cycle(c.nodes().select("time").distinct().withColumn("month", F.floor(F.col("time") / 10)))


@query(f"WITH {RWPS} SELECT floor(weighted_lon / 10) * 10 AS lon_bin, floor(weighted_lat / 10) * 10 AS lat_bin, count(*) AS n FROM rwps GROUP BY 1, 2")
def spatial_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).spatial_frequency()


@query(f"WITH {RWPS} SELECT round(corr(peak_amp, zonal_extent_deg), 6) AS r FROM rwps")
def amplitude_extent_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalogue(spark, sf_dir).amplitude_extent_correlation(), "r")


@query(f"WITH {RWPS} SELECT time, rwp_id, round({hav('weighted_lat', 'weighted_lon', '50', '20')}, 6) AS km FROM rwps WHERE time = 4 ORDER BY {hav('weighted_lat', 'weighted_lon', '50', '20')}, rwp_id LIMIT 1")
def packet_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalogue(spark, sf_dir).packet_at(20, 50, 4), "km")


@query(f"""WITH {RWPS}, p AS (SELECT time, rwp_id FROM rwps WHERE time = 4 ORDER BY {hav('weighted_lat', 'weighted_lon', '50', '20')}, rwp_id LIMIT 1), n AS (SELECT nodes.* FROM nodes JOIN p USING (time, rwp_id))
SELECT time, rwp_id, arg_min(node_type, {hav('lat', 'lon', '50', '20')}) AS node_type, round((20 - max(CASE WHEN lon <= 20 THEN lon END)) / (min(CASE WHEN lon > 20 THEN lon END) - max(CASE WHEN lon <= 20 THEN lon END)), 6) AS fraction FROM n GROUP BY 1, 2""")
def phase_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalogue(spark, sf_dir).phase_at(20, 50, 4), "fraction")


@query(f"""WITH {RWPS}, pts AS (SELECT time, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, lat, node_id, rwp_id AS owner FROM nodes)
SELECT time, lon, lat, node_id, owner, EXISTS (SELECT 1 FROM rwps r WHERE r.time = pts.time AND {hav('pts.lat', 'pts.lon', 'r.weighted_lat', 'r.weighted_lon')} <= 850) AS matched FROM pts""")
def match_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir)
    points = c.nodes().select("time", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")).alias("lon"), "lat", "node_id", F.col("rwp_id").alias("owner"))
    return c.match_points(points)


# tracking


@query(f"WITH {CELLS} SELECT time, rwp_id, round(energy, 6) AS energy FROM energy")
def feature_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.feature_energies(adapters.cells(spark, sf_dir)), "energy")


@query(f"WITH {CELLS} SELECT time_to, feat_from, feat_to, round(overlap, 6) AS overlap FROM lap")
def overlap_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.overlaps(adapters.cells(spark, sf_dir)), "overlap")


@query(f"WITH {CELLS} SELECT time_to, feat_from, feat_to, round(overlap, 6) AS overlap FROM lap")
def streamed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of files of cells, whose last one ends the last step."""
    from .streaming import overlap

    start = F.lit("2024-01-01").cast("timestamp")
    cells = adapters.cells(spark, sf_dir).select((start + F.make_dt_interval(days=F.col("time").cast("int"))).alias("ts"), "row", "col", "rwp_id", "energy")
    source, out = path(spark, "cells"), path(spark, "streamed")
    cells.write.parquet(source)
    whole = spark.read.parquet(source)
    save(overlap.end_mark(whole)).write.mode("append").parquet(source)
    stream = overlap.overlap_edges(spark.readStream.schema(whole.schema).parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(out)
    return rounded(found.select(F.datediff("ts", start).cast("long").alias("time_to"), "feat_from", "feat_to", "overlap"), "overlap")


@query(f"WITH {CELLS} SELECT src, dst, time_from, feat_from, time_to, feat_to, round(weight, 6) AS weight, round(distance, 5) AS distance FROM te")
def track_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(catalogue(spark, sf_dir).tracks()[1], "weight"), "distance", places=5)


@query(f"WITH {CELLS} SELECT src, dst, round(weight, 6) AS weight FROM te WHERE distance < 5000 AND weight >= 0.05")
def pruned_track_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.prune(catalogue(spark, sf_dir).tracks()[1], 5000, 0.05).select("src", "dst", "weight"), "weight")


@query(f"WITH {CELLS} SELECT dst AS key, count(*) AS n FROM te GROUP BY 1 HAVING count(*) > 1")
def track_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).merges()


@query(f"WITH {CELLS} SELECT src AS key, count(*) AS n FROM te GROUP BY 1 HAVING count(*) > 1")
def track_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).splits()


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[Catalogue, DataFrame]:
    c = catalogue(spark, sf_dir)
    tables = c.tables | {n: save(c.tables[n], n) for n in ("track_nodes", "track_edges")}
    c = Catalogue(tables, c.meta)
    return c, save(c.track_paths(save=save), "paths")


#: Heaviest paths: one row for each step of time, with what is known of its vertices.
PATHS = f"""{CELLS}, te_ AS MATERIALIZED (SELECT * FROM te),
walk(t, st) AS (SELECT (SELECT min(time_from) FROM te_), CAST([] AS STRUCT(key VARCHAR, best DOUBLE, before VARCHAR)[])
  UNION ALL SELECT t + 1, (SELECT list(struct_pack(key := dst, best := best, before := before)) FROM (SELECT dst, max(w) AS best, min(src) FILTER (w = top) AS before
    FROM (SELECT e.dst, e.src, coalesce(s.best, 0) + e.weight AS w, max(coalesce(s.best, 0) + e.weight) OVER (PARTITION BY e.dst) AS top FROM te_ e LEFT JOIN (SELECT unnest(walk.st, recursive := true)) s ON s.key = e.src WHERE e.time_to = walk.t + 1) GROUP BY dst))
  FROM walk WHERE t < (SELECT max(time_to) FROM te_)),
best AS MATERIALIZED (SELECT unnest(st, recursive := true) FROM walk),
back(sink, weight, key, before, n) AS (SELECT key, best, key, before, 0 FROM best WHERE key NOT IN (SELECT src FROM te_) UNION ALL SELECT sink, weight, b.before, p.before, n + 1 FROM back b LEFT JOIN best p ON p.key = b.before WHERE b.before IS NOT NULL),
roots AS (SELECT sink, weight, arg_max(key, n) AS root, max(n) AS length FROM back GROUP BY 1, 2),
won AS (SELECT sink, weight, length FROM roots QUALIFY row_number() OVER (PARTITION BY root ORDER BY weight DESC, sink) = 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY weight DESC, sink) - 1 AS track_id FROM won),
paths AS MATERIALIZED (SELECT track_id, CAST(length - n AS BIGINT) AS pos, key FROM back JOIN numbered USING (sink))"""


@query(f"WITH RECURSIVE {PATHS} SELECT track_id, pos, key FROM paths")
def track_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracks(spark, sf_dir)[1].withColumn("track_id", F.col("track_id").cast("long"))


@query(f"WITH RECURSIVE {PATHS} SELECT track_id, pos, key FROM paths")
def streamed_track_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of edges that stops and goes on twice, each time with a later part of the steps."""
    from .streaming import tracks

    edges = save(catalogue(spark, sf_dir).tracks()[1].select(F.col("time_to").cast("long").alias("time_to"), "src", "dst", "weight"), "edges")
    third = F.ntile(3).over(Window.orderBy("time_to"))  # a row for each step of time
    parts = edges.join(edges.select("time_to").distinct().select("time_to", third.alias("part")), "time_to")
    source, folder = path(spark, "arriving"), path(spark, "tracks")
    for i in (1, 2, 3):
        parts.filter(F.col("part") == i).drop("part").write.mode("append").parquet(source)
        if i == 3:
            tracks.end_mark(edges).write.mode("append").parquet(source)
        tracks.follow(spark.readStream.schema(tracks.EDGE).parquet(source), folder).trigger(availableNow=True).start().awaitTermination()
    return tracks.tracks(spark, folder).withColumn("track_id", F.col("track_id").cast("long"))


_SEP = "least(abs(b.lon - a.lon) % 360, 360 - abs(b.lon - a.lon) % 360)"


@query(f"""WITH RECURSIVE {PATHS}, v AS (SELECT track_id, pos, paths.key, time, lon, lat FROM paths JOIN places ON paths.key = time || ':' || rwp_id),
e AS (SELECT track_id, arg_min(struct_pack(time, lon, lat, key), pos) AS a, arg_max(struct_pack(time, lon, lat, key), pos) AS b FROM v GROUP BY 1),
s AS (SELECT track_id, ((lon - lag(lon) OVER (PARTITION BY track_id ORDER BY pos) + 180) % 360 + 360) % 360 - 180 AS step FROM v),
d AS (SELECT track_id, CASE WHEN max(abs(step)) > 40 THEN '-infinity'::DOUBLE ELSE coalesce(sum(step), 0) END AS drift FROM s GROUP BY 1),
x AS (SELECT track_id, bool_or(lon BETWEEN -90 AND 90 AND lat BETWEEN 30 AND 70) AS through FROM v GROUP BY 1)
SELECT track_id, (b.time - a.time) * 24.0::DOUBLE AS hours, round({_SEP}, 6) AS degrees, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 1000 / nullif((b.time - a.time) * 24 * 3600, 0), 6) AS m_per_s, a.key AS key, round(drift, 6) + 0.0 AS drift, through
FROM e JOIN d USING (track_id) JOIN x USING (track_id)""")
def track_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = _tracks(spark, sf_dir)
    box = c.tracks_through(p, (-90, 90, 30, 70)).withColumn("through", F.lit(True))
    out = c.track_durations(p).join(c.track_propagation(p), "track_id").join(c.group_velocity(p), "track_id").join(c.provenance(p), "track_id").join(c.drift(p), "track_id").join(box, "track_id", "left")
    out = out.withColumn("through", F.coalesce("through", F.lit(False))).withColumn("track_id", F.col("track_id").cast("long"))
    return rounded(out, "degrees", "m_per_s", "drift")


@query(f"""WITH RECURSIVE {PATHS}, h AS (SELECT (max(CAST(split_part(key, ':', 1) AS BIGINT)) - min(CAST(split_part(key, ':', 1) AS BIGINT))) * 24.0::DOUBLE AS hours FROM paths GROUP BY track_id),
e AS (SELECT min(hours) AS lo, max(hours) AS hi, count(*) AS n FROM h), w AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi, n FROM e),
b AS (SELECT i, lo + (hi - lo) * i / 10 AS l, lo + (hi - lo) * (i + 1) / 10 AS r, n FROM w, range(10) t(i))
SELECT round(l, 6) AS left, round(r, 6) AS right, round((SELECT count(*) FROM h WHERE hours >= l AND (hours < r OR i = 9 AND hours <= r)) / (n * (r - l)), 6) AS density FROM b""")
def track_duration_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = _tracks(spark, sf_dir)
    return rounded(c.duration_pdf(p, 10), "left", "right", "density")


@query(f"""WITH RECURSIVE {PATHS}, h AS (SELECT track_id, (max(CAST(split_part(key, ':', 1) AS BIGINT)) - min(CAST(split_part(key, ':', 1) AS BIGINT))) * 24.0::DOUBLE AS hours FROM paths GROUP BY track_id)
SELECT track_id, hours FROM h ORDER BY hours DESC, track_id LIMIT 8""")
def longest_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = _tracks(spark, sf_dir)
    return c.longest_tracks(p, 8).withColumn("track_id", F.col("track_id").cast("long"))


@query(f"""WITH {NODES}, p AS (SELECT time, rwp_id, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM nodes WINDOW w AS (PARTITION BY time, rwp_id ORDER BY cluster_id)),
e AS (SELECT time, rwp_id, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS km FROM p WHERE lon2 IS NOT NULL),
x AS (SELECT n.time, n.rwp_id, count(km) AS n, coalesce(sum(km), 0) AS extent FROM (SELECT DISTINCT time, rwp_id FROM nodes) n LEFT JOIN e USING (time, rwp_id) GROUP BY 1, 2),
y AS (SELECT time, count(*) AS n_packets, avg(n) AS edges_per_packet, avg(extent) AS extent_km FROM x GROUP BY 1), z AS (SELECT time, avg(km) AS mean_km, quantile_cont(km, 0.5) AS median_km, max(km) AS max_km FROM e GROUP BY 1)
SELECT time, n_packets, round(edges_per_packet, 6) AS edges_per_packet, round(extent_km, 5) AS extent_km, round(mean_km, 5) AS mean_km, round(median_km, 5) AS median_km, round(max_km, 5) AS max_km FROM y LEFT JOIN z USING (time)""")
def path_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(catalogue(spark, sf_dir).path_statistics(), "edges_per_packet"), "extent_km", "mean_km", "median_km", "max_km", places=5)


@query(f"""WITH {NODES}, s AS (SELECT *, least(abs(lon - lag(lon) OVER w), 360 - abs(lon - lag(lon) OVER w)) AS step FROM nodes WINDOW w AS (PARTITION BY time, rwp_id ORDER BY cluster_id)),
p AS (SELECT time, rwp_id, count(*) AS n, arg_min(lon, cluster_id) AS start, coalesce(sum(step), 0) AS arc, min(lat) AS low, max(lat) AS high FROM s GROUP BY 1, 2),
b AS (SELECT DISTINCT time, rwp_id, low, high, CAST(round_even((start + k) % 360, 0) AS BIGINT) % 360 AS bin FROM p, range(0, 361) r(k) WHERE k <= least(floor(arc), 360)),
m AS (SELECT DISTINCT a.time, a.rwp_id FROM b a JOIN b c ON a.time = c.time AND a.bin = c.bin AND a.rwp_id <> c.rwp_id AND greatest(a.low, c.low) - least(a.high, c.high) <= 15)
SELECT time, count(*) FILTER (n = 1) AS single, count(m.rwp_id) AS interleaved FROM p LEFT JOIN m USING (time, rwp_id) GROUP BY time""")
def packet_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).anomalies()


# the field as a surface

MESH = f"""{FIELD}, pt AS (SELECT time, lat_idx AS r, lon_idx AS c, CAST(lat_idx * 144 + lon_idx AS VARCHAR) AS id, lat, lon, v FROM field),
quad AS (SELECT p1.time, p1 AS p, p2 AS q, p3 AS s, p4 AS t FROM pt p1 JOIN pt p2 ON p2.time = p1.time AND p2.r = p1.r AND p2.c = (p1.c + 1) % 144 JOIN pt p3 ON p3.time = p1.time AND p3.r = p1.r + 1 AND p3.c = p2.c JOIN pt p4 ON p4.time = p1.time AND p4.r = p1.r + 1 AND p4.c = p1.c),
tri AS (SELECT time, p AS a, q AS b, s AS c FROM quad UNION ALL SELECT time, p, s, t FROM quad),
side AS (SELECT DISTINCT time, CASE WHEN x.id < y.id THEN x ELSE y END AS a, CASE WHEN x.id < y.id THEN y ELSE x END AS b FROM (SELECT time, a AS x, b AS y FROM tri UNION ALL SELECT time, b, c FROM tri UNION ALL SELECT time, a, c FROM tri))"""


@query(f"""WITH {MESH} SELECT time, a.id AS a, b.id AS b, round(2 * 6371 * sin({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / (2 * 6371)), 6) AS km FROM side""")
def surface_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surface.edges(surface.triangles(adapters.field(spark, sf_dir), adapters.NLON)), "km")


def _clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = surface.triangles(adapters.field(spark, sf_dir), adapters.NLON).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    return surface.clip(signed, lambda p: p["v"] * F.col("sign"), 8.0)


@query(f"""WITH {MESH}, sides AS (SELECT time, sign, a, b, a.v * sign AS f, b.v * sign AS g FROM side, (VALUES (1), (-1)) s(sign)),
cut AS (SELECT time, sign, a, b, (8 - f) / (g - f) AS t FROM sides WHERE (f > 8 AND g < 8) OR (f < 8 AND g > 8))
SELECT time, sign, '(' || a.id || '|' || b.id || ')' AS id, round(a.lat + t * (b.lat - a.lat), 6) AS lat, round((((a.lon + t * (((b.lon - a.lon + 180) % 360 + 360) % 360 - 180)) % 360) + 360) % 360, 6) AS lon, round(a.v + t * (b.v - a.v), 6) AS v FROM cut
UNION ALL SELECT DISTINCT time, sign, x.id, x.lat, x.lon, x.v FROM (SELECT time, sign, unnest([a, b]) AS x FROM sides WHERE f >= 8 OR g >= 8) WHERE x.v * sign >= 8 AND (time, sign, x.id) IN
  (SELECT (time, sign, unnest([a.id, b.id, c.id])) FROM tri, (VALUES (1), (-1)) s(sign) WHERE (a.v * sign > 8)::INT + (b.v * sign > 8)::INT + (c.v * sign > 8)::INT > 0 OR (a.v * sign >= 8 AND b.v * sign >= 8 AND c.v * sign >= 8))""")
def clip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of both clips at 8: those of the grid, and where edges are cut."""
    return rounded(surface.corners(_clipped(spark, sf_dir)).distinct(), "lat", "lon", "v")


@query(f"""WITH {MESH}, n AS (SELECT time, sign, (a.v * sign >= 8)::INT + (b.v * sign >= 8)::INT + (c.v * sign >= 8)::INT AS inside, (a.v * sign = 8)::INT + (b.v * sign = 8)::INT + (c.v * sign = 8)::INT AS ties FROM tri, (VALUES (1), (-1)) s(sign))
SELECT time, sign, CAST(sum(CASE WHEN inside = 3 THEN 1 WHEN inside = 2 THEN 2 - ties WHEN inside = 1 THEN 1 - ties ELSE 0 END) AS BIGINT) AS n FROM n GROUP BY 1, 2""")
def clip_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clipped(spark, sf_dir).groupBy("time", "sign").agg(F.count("*").alias("n"))


# comparison of masks


def _masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = adapters.field(spark, sf_dir)
    pixel = lambda df: df.select("time", F.col("lat_idx").alias("row"), F.col("lon_idx").alias("col"))
    a = pixel(compare.envelope_mask(stencil.envelope(f), 14.0))
    return a, pixel(f.filter(F.abs("v") >= 20)), f.select("time").distinct()


MASKS = f"""{ENVELOPE}, a AS (SELECT time, lat_idx AS row, lon_idx AS col FROM env WHERE envelope >= 14), b AS (SELECT time, lat_idx AS row, lon_idx AS col FROM field WHERE abs(v) >= 20),
j AS (SELECT time, row, col, a.time IS NOT NULL AS x, b.time IS NOT NULL AS y FROM a FULL JOIN b USING (time, row, col))"""


@query(f"""WITH {ENVELOPE}, a AS (SELECT time, lat_idx, lon_idx, 1 AS x FROM env WHERE envelope >= 14), b AS (SELECT time, lat_idx, lon_idx, 1 AS y FROM field WHERE abs(v) >= 20),
j AS (SELECT f.time, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM field f LEFT JOIN a USING (time, lat_idx, lon_idx) LEFT JOIN b USING (time, lat_idx, lon_idx))
SELECT time, CAST(sum(x * y) AS BIGINT) AS shared, CAST(sum(greatest(x, y)) AS BIGINT) AS joint, round(coalesce(sum(x * y) / nullif(sum(greatest(x, y)), 0), 1), 6) AS iou, max(x) = max(y) AS agree FROM j GROUP BY time""")
def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.iou(*_masks(spark, sf_dir)), "iou")


@query(f"""WITH {ENVELOPE}, a AS (SELECT time, lat_idx, lon_idx, 1 AS x FROM env WHERE envelope >= 14), b AS (SELECT time, lat_idx, lon_idx, 1 AS y FROM field WHERE abs(v) >= 20),
j AS (SELECT f.time, lat_idx, lon_idx, f.lat, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM field f LEFT JOIN a USING (time, lat_idx, lon_idx) LEFT JOIN b USING (time, lat_idx, lon_idx))
SELECT floor(lat / 5.0) * 5.0 AS band, CAST(sum(x * y) AS BIGINT) AS both, CAST(sum(x * (1 - y)) AS BIGINT) AS only_a, CAST(sum(y * (1 - x)) AS BIGINT) AS only_b FROM j WHERE x + y > 0 GROUP BY 1""")
def mask_by_latitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = _masks(spark, sf_dir)
    lats = adapters.field(spark, sf_dir).select(F.col("lat_idx").alias("row"), F.col("lon_idx").alias("col"), "lat").distinct()
    return compare.by_latitude(a, b, lats)


_AB = """a AS (SELECT time, lat_idx, lon_idx, 1 AS x FROM env WHERE envelope >= 14), b AS (SELECT time, lat_idx, lon_idx, 1 AS y FROM field WHERE abs(v) >= 20),
j AS (SELECT f.time, lat_idx, lon_idx, f.lat, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM field f LEFT JOIN a USING (time, lat_idx, lon_idx) LEFT JOIN b USING (time, lat_idx, lon_idx))"""


@query(f"""WITH {ENVELOPE}, {_AB}, g AS (SELECT DISTINCT lat_idx, lon_idx, floor(lat / 5.0) * 5.0 AS band FROM field WHERE lat < 80), n AS (SELECT band, count(*) * (SELECT count(DISTINCT time) FROM field) AS n FROM g GROUP BY 1)
SELECT band, round(coalesce(sum(x * y), 0) / n, 9) AS both, round(coalesce(sum(x * (1 - y)), 0) / n, 9) AS only_a, round(coalesce(sum(y * (1 - x)), 0) / n, 9) AS only_b FROM n LEFT JOIN (SELECT floor(lat / 5.0) * 5.0 AS band, x, y FROM j WHERE lat < 80) USING (band) GROUP BY band, n""")
def mask_shares_by_latitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, times = _masks(spark, sf_dir)
    lats = adapters.field(spark, sf_dir).select(F.col("lat_idx").alias("row"), F.col("lon_idx").alias("col"), "lat").distinct()
    return rounded(compare.latitude_shares(a, b, lats, times.count()), "both", "only_a", "only_b", places=9)


@query(f"""WITH {ENVELOPE}, {_AB}, n AS (SELECT count(DISTINCT time) AS n FROM field)
SELECT lat_idx AS row, lon_idx AS col, round(sum(x * y) / max(n), 9) AS both, round(sum(x * (1 - y)) / max(n), 9) AS only_a, round(sum(y * (1 - x)) / max(n), 9) AS only_b FROM j, n GROUP BY 1, 2 HAVING sum(x + y) > 0""")
def mask_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, times = _masks(spark, sf_dir)
    return rounded(compare.frequency(a, b, times.count()), "both", "only_a", "only_b", places=9)


@query(f"""WITH {ENVELOPE}, {_AB}, n AS (SELECT time, count(*) AS n FROM field GROUP BY 1)
SELECT time, round(sum(x * (1 - y)) / 3600, 9) AS only_a, round(sum(y * (1 - x)) / 3600, 9) AS only_b FROM j GROUP BY time HAVING sum(x + y) > 0""")
def mask_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = _masks(spark, sf_dir)
    return rounded(compare.disagreement(a, b, adapters.NLAT * adapters.NLON), "only_a", "only_b", places=9)


@query(f"""WITH {ENVELOPE}, s AS (SELECT t AS threshold, f.time, count(*) FILTER (envelope >= 14 AND abs(v) >= t) AS i, count(*) FILTER (envelope >= 14 OR abs(v) >= t) AS u, max((envelope >= 14)::INT) = max((abs(v) >= t)::INT) AS agree
FROM env JOIN field f USING (time, lat_idx, lon_idx), (VALUES (10.0), (15.0), (20.0), (25.0)) x(t) GROUP BY 1, 2),
means AS (SELECT threshold, avg(coalesce(i / nullif(u, 0), 1)) AS m FROM s GROUP BY 1)
SELECT 'amplitude' AS method, CAST(arg_max(threshold, m) AS DOUBLE) AS threshold, round(max(m), 6) AS mean_iou FROM means""")
def best_amplitude_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, times = _masks(spark, sf_dir)
    f = adapters.field(spark, sf_dir)
    runs = None
    for t in (10.0, 15.0, 20.0, 25.0):
        b = f.filter(F.abs("v") >= t).select("time", F.col("lat_idx").alias("row"), F.col("lon_idx").alias("col"))
        one = compare.iou(a, b, times).select(F.lit("amplitude").alias("method"), F.lit(t).alias("threshold"), "time", "iou", "agree")
        runs = one if runs is None else runs.unionByName(one)
    return rounded(compare.best_threshold(compare.sweep(runs)), "mean_iou")


# The polar raster in SQL: pixels of the band with the field's nearest cells, and the envelope's mask there.
_RASTER = 512
_T = "sqrt(x * x + y * y) * sqrt(pow(1 + e, 1 + e) * pow(1 - e, 1 - e)) / (2 * 6378137.0)"
_PHI = "SELECT * EXCLUDE (phi), pi() / 2 - 2 * atan(t * pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2)) AS phi FROM"
POLAR = f"""{ENVELOPE}, xy AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, -hw + (c + 0.5) * (2 * hw / {_RASTER}) AS x, hw - (r + 0.5) * (2 * hw / {_RASTER}) AS y, 0.0818191908426215 AS e
  FROM range({_RASTER}) a(r), range({_RASTER}) b(c), (SELECT CAST(12713600.098850505 AS DOUBLE) AS hw)),
phi0 AS (SELECT *, {_T} AS t, pi() / 2 - 2 * atan({_T}) AS phi FROM xy), {", ".join(f"phi{i + 1} AS ({_PHI} phi{i})" for i in range(6))},
px AS (SELECT row, col, degrees(phi) AS lat, (degrees(atan2(x, -y)) + 360) % 360 AS lon FROM phi6 WHERE degrees(phi) BETWEEN 20 AND 80),
pc AS (SELECT row, col, CAST(ceil((lat - 20) / 2.5 - 0.5) AS INTEGER) AS lat_idx, CAST(ceil(lon / 2.5 - 0.5) AS INTEGER) AS lon_idx FROM px WHERE lon <= 357.5),
seen AS (SELECT time, row, col FROM env JOIN pc USING (lat_idx, lon_idx) WHERE envelope >= 6)"""


@query(f"WITH {POLAR} SELECT time, row, count(*) AS n, CAST(sum(col) AS BIGINT) AS cols FROM seen GROUP BY 1, 2")
def polar_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wave envelope's mask on the polar raster: pixels of each of its rows."""
    f = adapters.field(spark, sf_dir)
    grid = compare.in_band(compare.pixel_grid(spark, _RASTER, frames.HALF_WIDTH))
    seen = compare.regrid(compare.envelope_mask(stencil.envelope(f), 6.0), compare.nearest_cells(grid, f))
    return seen.groupBy("time", "row").agg(F.count("*").alias("n"), F.sum("col").alias("cols"))


_CELL = "CAST(floor(({v} + 12713600.098850505) / (2 * 12713600.098850505 / 512)) AS INTEGER)"


@query(f"""WITH {POLAR}, p AS (SELECT f.*, n_lon, n_lat FROM field f JOIN (SELECT time, max(lon_idx) + 1 AS n_lon, max(lat_idx) + 1 AS n_lat FROM field GROUP BY time) USING (time)),
{_extrema_cte('hi', 'max', 'greatest', 'v > 20')}, {_extrema_cte('lo', 'min', 'least', 'v < -20 AND p.lat_idx > 0')}, ex AS (SELECT time, lat, lon, abs(v) AS level FROM hi UNION ALL SELECT time, lat, lon, abs(v) FROM lo),
er AS (SELECT time, level, lon, 0.0818191908426215 AS e, radians(lat) AS phi FROM ex),
exy AS (SELECT time, level, rho * sin(radians(lon)) AS x, -rho * cos(radians(lon)) AS y FROM (SELECT *, tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2) * 2 * 6378137.0 / sqrt(pow(1 + e, 1 + e) * pow(1 - e, 1 - e)) AS rho FROM er)),
hit AS (SELECT time, 511 - up AS row, col, max(level) AS level FROM exy, LATERAL (SELECT unnest(range({_CELL.format(v='x - 10000')}, {_CELL.format(v='x + 10000')} + 1)) AS col) a, LATERAL (SELECT unnest(range({_CELL.format(v='y - 10000')}, {_CELL.format(v='y + 10000')} + 1)) AS up) b GROUP BY 1, 2, 3),
lv AS (SELECT time, row, col, level FROM hit JOIN px USING (row, col)),
th AS (SELECT time, t AS threshold FROM (SELECT DISTINCT time FROM field), (VALUES (10.0), (20.0), (30.0), (40.0), (50.0), (60.0)) x(t)),
n AS (SELECT th.time, threshold, count(lv.time) AS n, count(seen.time) AS shared FROM th LEFT JOIN lv ON lv.time = th.time AND level >= threshold LEFT JOIN seen ON seen.time = lv.time AND seen.row = lv.row AND seen.col = lv.col GROUP BY 1, 2),
tot AS (SELECT time, count(*) AS total FROM seen GROUP BY time),
r AS (SELECT threshold, n, shared, coalesce(total, 0) AS total, (SELECT count(*) FROM px) AS np FROM n LEFT JOIN tot USING (time))
SELECT 'node_amplitude' AS method, CAST(threshold AS DOUBLE) AS threshold, round(avg(coalesce(shared / nullif(n + total - shared, 0), 1)), 9) AS mean_iou, avg(CAST((n > 0) = (total > 0) AS INT)) AS agreement,
round(avg((n - shared) / np), 9) AS mean_only_a, round(avg((total - shared) / np), 9) AS mean_only_b, count(*) AS n FROM r GROUP BY threshold""")
def amplitude_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extrema as footprints, at six thresholds, against the wave envelope on the polar raster, in one pass."""
    f = adapters.field(spark, sf_dir)
    grid = save(compare.in_band(compare.pixel_grid(spark, _RASTER, frames.HALF_WIDTH)), "grid")
    seen, cells = compare.envelope_mask(stencil.envelope(f), 6.0), save(compare.nearest_cells(grid, f), "cells")
    high, low = _extrema(spark, sf_dir)
    x, y = geo.to_stereographic("lat", "lon")
    points = high.unionByName(low).select("time", F.lit(0).cast("long").alias("rwp_id"), F.col("id").alias("node"), F.abs("v").alias("level"), x.alias("x"), y.alias("y"))
    hulls = frames.node_hulls(points).join(points.select("time", "node", "level"), ["time", "node"])
    levels = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
    hits = compare.levelled(frames.touched(hulls, _RASTER).join(grid.select("row", "col"), ["row", "col"]), "node_amplitude", levels)
    thresholds = spark.createDataFrame([("node_amplitude", t, True) for t in levels], "method string, threshold double, suffix boolean")
    runs = compare.agreement(hits, seen, thresholds, f.select("time"), grid.count(), cells)
    return rounded(compare.sweep(runs), "mean_iou", "mean_only_a", "mean_only_b", places=9)


# whole plans


@query(f"""WITH RECURSIVE {FIELD}, s AS MATERIALIZED (SELECT time, lat_idx * 144 + lon_idx AS cell, lat_idx, lon_idx, sign(v) AS sign FROM field WHERE abs(v) >= 8),
n AS MATERIALIZED (SELECT a.time * 3600 + a.cell AS a, b.time * 3600 + b.cell AS b FROM s a JOIN s b ON a.time = b.time AND a.sign = b.sign AND abs(a.lat_idx - b.lat_idx) <= 1 AND (abs(a.lon_idx - b.lon_idx) <= 1 OR abs(a.lon_idx - b.lon_idx) = 143) AND a.cell <> b.cell),
r(node, name) USING KEY (node) AS (SELECT time * 3600 + cell, time * 3600 + cell FROM s UNION (SELECT n.b, min(r.name) FROM r JOIN n ON n.a = r.node JOIN recurring.r o ON o.node = n.b GROUP BY n.b HAVING min(r.name) < min(o.name)))
SELECT CAST(node // 3600 AS INTEGER) AS time, CAST(node % 3600 AS BIGINT) AS cell, CAST(name % 3600 AS BIGINT) AS region FROM r""")
def field_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.identify import regions

    return regions(adapters.field(spark, sf_dir), 8.0, adapters.NLON)


def _settings():
    from .config import Config

    return Config.default(min_latitude=20.0, max_latitude=80.0, extrema_threshold=15.0, edge_pruning_threshold=0.02)


def _identified(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from .plans.identify import identify

    return identify(adapters.field(spark, sf_dir), _settings(), n_lon=adapters.NLON)


@query()
def identified_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of the field, from extrema to footprints."""
    return _identified(spark, sf_dir)["rwps"].drop("geometry_wkb")


@query()
def identified_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of each packet's footprint in square kilometres, its polygons and holes, for each kind of hull."""
    from .config import Config
    from .plans.identify import identify

    out = None
    for kind in ("per_node", "convex", "concave"):
        found = identify(adapters.field(spark, sf_dir), Config.default(**vars(_settings()) | {"hull_method": kind}), n_lon=adapters.NLON)
        one = found["shapes"].select(F.lit(kind).alias("hull_method"), "time", "rwp_id", (F.col("area") / 1e6).alias("km2"), "polygons", "holes")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def identified_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and energies of the packets' footprints, on the raster of 512 x 512."""
    out = _identified(spark, sf_dir)
    return out["labels"].join(out["energies"], ["time", "row", "col"], "full")


@query()
def identified_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of pruned graphs and hulls of strong extrema against the wave envelope, at six thresholds each."""
    from .plans.identify import method_sweep

    runs = method_sweep(adapters.field(spark, sf_dir), _settings(), amplitudes=[15.0, 20.0, 25.0, 30.0, 35.0, 40.0], prunings=[0.0, 0.01, 0.02, 0.04, 0.06, 0.08], n_lon=adapters.NLON, pixels=_RASTER, reference=6.0)
    return compare.sweep(runs)


@query()
def identified_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field's packets followed through time: edges between adjacent steps, and which lie on a track."""
    from .plans.identify import track, tracks

    _, edges = track(_identified(spark, sf_dir))
    paths = tracks(edges, _settings()).select("track_id", "key")
    on = paths.select(F.col("key").alias("src"), "track_id").join(paths.select(F.col("key").alias("dst"), "track_id"), "track_id")
    return edges.join(on, ["src", "dst"], "left")


@query()
def identified_feature_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field's crests and troughs, each with its share of its region, followed through time."""
    from .operators import features
    from .plans.identify import extract_features
    found = save(extract_features(adapters.field(spark, sf_dir), _settings(), threshold=20.0, fraction=3.0, n_lon=adapters.NLON))
    return features.track(found, save, most_shift=15.0, band=(20.0, 80.0))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node as a feature of its packet's run, with a box of 40 x 20 degrees as footprint."""
    corner = lambda a, b: F.struct((F.col("lon") + a).alias("x"), (F.col("lat") + b).alias("y"))
    ring = F.array(corner(-20, -10), corner(20, -10), corner(20, 10), corner(-20, 10))
    return adapters.nodes(spark, sf_dir).select(F.col("rwp_id").cast("string").alias("run"), "time", F.col("cluster_id").alias("id"), F.lit("max").alias("node_type"), "lon", "lat", "scalar", ring.alias("ring"), geo.strength("scalar", 60).alias("strength"))


@query(f"""WITH {NODES}, cells AS (SELECT DISTINCT time, rwp_id, CAST(lon * 2 AS BIGINT) + x AS x, CAST(lat * 2 AS BIGINT) + y AS y FROM nodes, range(-10, 10) i(x), range(-5, 5) j(y))
SELECT time, rwp_id, count(*) / 4.0 AS area FROM cells GROUP BY 1, 2""")
def packet_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet's footprint as the union of boxes of 10 x 5 degrees round its nodes."""
    corner = lambda a, b: F.struct((F.col("lon") + a).alias("x"), (F.col("lat") + b).alias("y"))
    ring = F.array(corner(-5, -2.5), corner(5, -2.5), corner(5, 2.5), corner(-5, 2.5))
    boxes = adapters.nodes(spark, sf_dir).select("time", "rwp_id", ring.alias("ring"))
    return frames.merged(boxes).select("time", "rwp_id", "area")


@query(f"""WITH {NODES}, parts AS (SELECT rwp_id, time, cluster_id AS id, lon, lat, lon - 20 AS x1, lon + x AS x2, lat + y1 AS y1, lat + y2 AS y2 FROM nodes, (VALUES (20, -10, 0), (0, 0, 10)) p(x, y1, y2)),
lap AS (SELECT a.rwp_id, a.time, a.id, b.id AS before, sum(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) AS shared FROM parts a JOIN parts b ON a.rwp_id = b.rwp_id AND a.time = b.time + 1
  WHERE sqrt(pow(((a.lon - b.lon + 180) % 360 + 360) % 360 - 180, 2) + pow(a.lat - b.lat, 2)) <= 40 GROUP BY 1, 2, 3, 4)
SELECT CAST(rwp_id AS VARCHAR) AS run, time, id, before, round(shared / (1200 - shared), 6) AS iou FROM lap WHERE shared > 0""")
def angular_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far features of adjacent steps overlap whose footprints are not convex: angles of two boxes."""
    from .operators import features

    corner = lambda a, b: F.struct((F.col("lon") + a).alias("x"), (F.col("lat") + b).alias("y"))
    ring = F.array(*(corner(*p) for p in ((-20, -10), (20, -10), (20, 0), (0, 0), (0, 10), (-20, 10))))
    return rounded(features.pairs(save(_features(spark, sf_dir).withColumn("ring", ring)), 40.0), "iou")


#: Settings of the feature tracks below, and the same in SQL: one row for each step of time, with its live features.
TRACKED = {"most_shift": 40.0, "band": (25.0, 75.0)}
STEPS = f"""{NODES}, f AS MATERIALIZED (SELECT CAST(rwp_id AS VARCHAR) AS run, time, cluster_id AS id, lon, lat, abs(scalar) >= 60 AS strong, lat BETWEEN 25 AND 75 AS inside, time = min(time) OVER (PARTITION BY rwp_id) AS first FROM nodes),
boxes AS (SELECT a.run, a.time, a.id, a.strong, b.id AS before, greatest(0, 40 - abs(a.lon - b.lon)) * greatest(0, 20 - abs(a.lat - b.lat)) AS shared
  FROM f a JOIN f b ON a.run = b.run AND a.time = b.time + 1 WHERE sqrt(pow(((a.lon - b.lon + 180) % 360 + 360) % 360 - 180, 2) + pow(a.lat - b.lat, 2)) <= 40),
near AS MATERIALIZED (SELECT run, time, id, strong, before, round(shared / (1600 - shared), 9) AS iou FROM boxes WHERE shared > 0),
live(t, st) AS (SELECT (SELECT min(time) FROM f) - 1, CAST([] AS STRUCT(run VARCHAR, time BIGINT, id BIGINT, lon DOUBLE, lat DOUBLE, before BIGINT, nth BIGINT, weak BIGINT)[])
  UNION ALL SELECT t + 1, (WITH heads AS (SELECT unnest(live.st, recursive := true)),
    met AS (SELECT n.*, h.weak FROM near n JOIN heads h ON n.run = h.run AND n.before = h.id WHERE n.time = live.t + 1),
    claim AS (SELECT * FROM met WHERE strong OR NOT EXISTS (SELECT 1 FROM (SELECT run, id, before FROM met WHERE strong QUALIFY row_number() OVER (PARTITION BY run, id ORDER BY iou DESC, before DESC) = 1) s WHERE s.run = met.run AND s.before = met.before)
              QUALIFY row_number() OVER (PARTITION BY run, id ORDER BY iou DESC, before DESC) = 1),
    nth AS (SELECT *, row_number() OVER (PARTITION BY run, before ORDER BY iou DESC, id DESC) AS nth FROM claim),
    now AS (SELECT f.*, c.before, c.nth, CASE WHEN f.strong OR c.weak IS NULL THEN 0 ELSE c.weak + 1 END AS weak, c.iou FROM f LEFT JOIN nth c ON c.run = f.run AND c.id = f.id WHERE f.time = live.t + 1)
    SELECT list(struct_pack(run, time, id, lon, lat, before, nth, weak)) FROM now
    WHERE CASE WHEN before IS NULL THEN strong AND (inside OR first) ELSE inside AND weak <= 2 AND (NOT strong OR nth = 1 OR iou >= 0.05) END) FROM live WHERE t < (SELECT max(time) FROM f)),
steps AS MATERIALIZED (SELECT unnest(st, recursive := true) FROM live),
named(run, time, id, track_id, began) AS (SELECT run, time, id, time || ':' || id, before FROM steps WHERE before IS NULL OR nth > 1
  UNION ALL SELECT s.run, s.time, s.id, n.track_id, n.began FROM named n JOIN steps s ON s.run = n.run AND s.time = n.time + 1 AND s.before = n.id AND s.nth = 1),
births AS MATERIALIZED (SELECT n.run, n.track_id, n.time AS cut, p.track_id AS parent_id FROM named n LEFT JOIN named p ON p.run = n.run AND p.time = n.time - 1 AND p.id = n.began WHERE n.track_id = n.time || ':' || n.id),
lines(run, track_id, parent_id, above, cut) AS (SELECT run, track_id, parent_id, parent_id, cut FROM births WHERE parent_id IS NOT NULL UNION ALL SELECT l.run, l.track_id, l.parent_id, b.parent_id, b.cut FROM lines l JOIN births b ON b.run = l.run AND b.track_id = l.above WHERE b.parent_id IS NOT NULL),
tracks AS MATERIALIZED (SELECT n.run, n.track_id, b.parent_id, n.time, n.id, s.lon, s.lat, s.weak > 0 AS recovered FROM named n JOIN births b USING (run, track_id) JOIN steps s ON s.run = n.run AND s.time = n.time AND s.id = n.id
  UNION ALL SELECT l.run, l.track_id, l.parent_id, n.time, n.id, s.lon, s.lat, s.weak > 0 FROM lines l JOIN named n ON n.run = l.run AND n.track_id = l.above AND n.time < l.cut JOIN steps s ON s.run = n.run AND s.time = n.time AND s.id = n.id)"""


def _feature_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import features
    return features.track(save(_features(spark, sf_dir)), save, **TRACKED)


@query(f"WITH RECURSIVE {STEPS} SELECT * FROM tracks")
def feature_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature_tracks(spark, sf_dir)


@query(f"""WITH RECURSIVE {STEPS}, s AS (SELECT *, ((lon - lag(lon) OVER (PARTITION BY run, track_id ORDER BY time) + 180) % 360 + 360) % 360 - 180 AS d FROM tracks)
SELECT run, track_id, round(sum(d) / nullif((max(time) - min(time)) * 24, 0), 6) + 0.0 AS degrees_per_hour FROM s GROUP BY 1, 2""")
def feature_velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import features

    return rounded(features.phase_velocity(_feature_tracks(spark, sf_dir), 24.0), "degrees_per_hour")


@query(f"""WITH RECURSIVE {STEPS}, up(run, track_id, root) AS (SELECT run, track_id, track_id FROM births WHERE parent_id IS NULL UNION ALL SELECT b.run, b.track_id, u.root FROM up u JOIN births b ON b.run = u.run AND b.parent_id = u.track_id)
SELECT run, track_id, root FROM up""")
def feature_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import features
    return features.roots(_feature_tracks(spark, sf_dir), save)


@query(f"WITH RECURSIVE {STEPS} SELECT * FROM tracks")
def streamed_feature_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tracks from a stream of feature files, whose last ones hold the ends of the runs."""
    from .operators import features
    from .sources.staging import path as new_path, save

    source = new_path(spark, "features")
    _features(spark, sf_dir).write.parquet(source)
    features.ends(spark.read.parquet(source)).write.mode("append").parquet(source)
    stream = features.stream_track(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), **TRACKED)
    out = new_path(spark, "streamed")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return features.with_history(spark.read.schema(stream.schema).parquet(out), save)
