"""Reading and preparing gridded fields, kept as long tables (time, lat_idx, lon_idx, lat, lon, v)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.FIELD).parquet(path)


def read_netcdf(spark: SparkSession, path: str, scalar: str = "v", time: str = "time", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """NetCDF or Zarr stores through xarray, where that is installed; each task opens the store for its own time steps."""
    try:
        import xarray
    except ImportError as e:
        raise NotImplementedError("NetCDF and Zarr need xarray; store fields as Parquet with schema.FIELD") from e
    with xarray.open_dataset(path) as data:
        n = data.sizes[time]

    def run(batches):
        with xarray.open_dataset(path) as data:
            for pdf in batches:
                for t in pdf["id"]:
                    frame = data[scalar].isel({time: int(t)}).to_dataframe(name="v").reset_index()
                    frame = frame.assign(time=t, lat_idx=frame[lat].rank(method="dense") - 1, lon_idx=frame[lon].rank(method="dense") - 1, lat=frame[lat], lon=frame[lon])
                    yield frame[["time", "lat_idx", "lon_idx", "lat", "lon", "v"]]

    return spark.range(n).repartition(max(1, n // 8)).mapInPandas(run, schema.FIELD)


def write_store(df: DataFrame, path: str, *, steps: int = 24, width: float = 10.0) -> None:
    """A field on disk in folders of ``steps`` time steps and ``width`` degrees of latitude, rows in order of time and
    latitude in each file, so that a selection reads the folders and the row groups that it needs and no others."""
    band = F.floor(F.col("lat") / width).cast("int")
    parts = df.withColumns({"steps": F.floor(F.col("time") / steps).cast("int"), "band": band}).repartition("steps", "band").sortWithinPartitions("steps", "band", "time", "lat_idx", "lon_idx")
    parts.write.partitionBy("steps", "band").parquet(f"{path}/cells")
    df.sparkSession.createDataFrame([(steps, float(width))], "steps int, width double").coalesce(1).write.parquet(f"{path}/layout")


def read_store(spark: SparkSession, path: str, *, low: float = -90.0, high: float = 90.0, start: int | None = None, stop: int | None = None, every: int = 1) -> DataFrame:
    """As select(), from such a store: bounds become bounds on folders and on what the files say of their rows."""
    steps, width = spark.read.parquet(f"{path}/layout").first()
    out = spark.read.schema(schema.FIELD + ", steps int, band int").parquet(f"{path}/cells")
    out = out.filter(F.col("band").between(math.floor(low / width), math.floor(high / width)) & F.col("lat").between(low, high))
    if start is not None:
        out = out.filter((F.col("steps") >= start // steps) & (F.col("time") >= start))
    if stop is not None:
        out = out.filter((F.col("steps") <= (stop - 1) // steps) & (F.col("time") < stop))
    if every > 1:
        out = out.filter((F.col("time") - (start or 0)) % every == 0)
    return out.drop("steps", "band")


def select(df: DataFrame, *, low: float, high: float, start: int = 0, stop: int | None = None, every: int = 1) -> DataFrame:
    """A latitude band, a time range and each ``every``-th step of it; a field that is stored is filtered in its scan."""
    out = df.filter(F.col("lat").between(low, high) & (F.col("time") >= start))
    out = out if stop is None else out.filter(F.col("time") < stop)
    return out.filter((F.col("time") - start) % every == 0)


def coarsen(df: DataFrame, n: int = 4) -> DataFrame:
    """Means over n x n blocks; partial blocks at the end are cut, longitudes are taken modulo 360."""
    full = df.groupBy("time", F.floor(F.col("lat_idx") / n).cast("int").alias("lat_idx"), F.floor(F.col("lon_idx") / n).cast("int").alias("lon_idx")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("v").alias("v"), F.count("*").alias("n"))
    return full.filter(F.col("n") == n * n).select("time", "lat_idx", "lon_idx", "lat", F.pmod("lon", F.lit(360.0)).alias("lon"), "v")


def mesh(df: DataFrame, radius: float = 63.71) -> DataFrame:
    """Points on the sphere, and for each the mean of the cell that it begins (none in the last row and column)."""
    lat, lon = F.radians("lat"), F.radians("lon")
    cell = df.select("time", F.explode(F.array(*(F.struct((F.col("lat_idx") - a).alias("lat_idx"), (F.col("lon_idx") - b).alias("lon_idx")) for a in (0, 1) for b in (0, 1)))).alias("c"), "v")
    mean = cell.groupBy("time", "c.lat_idx", "c.lon_idx").agg(F.avg("v").alias("cell_v"), F.count("*").alias("n")).filter("n = 4").drop("n")
    xyz = df.select("time", "lat_idx", "lon_idx", (radius * F.cos(lat) * F.cos(lon)).alias("x"), (radius * F.cos(lat) * F.sin(lon)).alias("y"), (radius * F.sin(lat)).alias("z"), "v")
    return xyz.join(mean, ["time", "lat_idx", "lon_idx"], "left")
