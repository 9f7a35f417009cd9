"""Event tables read as gridded fields, cells and catalogue tables, so that the engine runs on them at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import geo
from .staging import sized

#: A frame of the field holds so many latitudes and longitudes.
NLAT, NLON = 25, 144
#: Rows and columns of the label raster.
RASTER = 32


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is one grid cell: frames of 25 x 144 cells in the order of ids, 20 to 80 north, all longitudes."""
    cell = F.pmod(F.col("event_id"), F.lit(NLAT * NLON))
    e = events(spark, sf_dir).select((F.col("event_id") / (NLAT * NLON)).cast("int").alias("time"), F.floor(cell / NLON).cast("int").alias("lat_idx"), F.pmod(cell, F.lit(NLON)).cast("int").alias("lon_idx"), F.round(F.when(F.col("event_type").isin("click", "view"), F.col("value")).otherwise(-F.col("value")) / 10, 3).alias("v"))
    return e.select("time", "lat_idx", "lon_idx", (20 + F.col("lat_idx") * 2.5).alias("lat"), (F.col("lon_idx") * 2.5).alias("lon"), "v")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user on a day are the nodes of a packet, in the order of ids."""
    e = events(spark, sf_dir).withColumn("time", F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long"))
    i = F.row_number().over(Window.partitionBy("time", "user_id").orderBy("event_id")).cast("long") - 1
    kind = F.when(F.col("event_id") % 2 == 0, "max").otherwise("min")
    e = e.select("time", F.col("user_id").alias("rwp_id"), i.alias("cluster_id"), kind.alias("node_type"), (F.pmod(F.col("event_id") * 37, F.lit(720)) / 2).alias("lon"), (20 + F.pmod(F.col("event_id") * 13, F.lit(121)) / 2).alias("lat"), F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")).alias("scalar"), F.pmod("event_id", F.lit(5)).cast("long").alias("region_id"))
    return e.select("time", "rwp_id", geo.node_id("node_type", "cluster_id").alias("node_id"), "node_type", "lon", "lat", "scalar", "cluster_id", "region_id")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse label and energy raster of each day: where packets fall on one cell, the later event wins."""
    e = events(spark, sf_dir)
    row, col = F.pmod(F.col("event_id") * 7, F.lit(RASTER)), F.pmod(F.floor(F.col("value")), F.lit(RASTER))
    e = e.select(F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("time"), row.cast("int").alias("row"), col.cast("int").alias("col"), (F.col("user_id") % 40 + 1).alias("rwp_id"), (F.col("value") * F.col("value")).alias("energy"), "event_id")
    return e.groupBy("time", "row", "col").agg(F.max_by(F.struct("rwp_id", "energy"), "event_id").alias("x")).select("time", "row", "col", "x.rwp_id", "x.energy")
