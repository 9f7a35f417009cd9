"""The six tables and their metadata in a folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema


def save(tables: dict[str, DataFrame], path: str, meta: dict | None = None, *, partition: bool = False) -> None:
    """Write each table (missing ones empty) as Parquet, and the metadata as one line of JSON."""
    spark = next(iter(tables.values())).sparkSession
    for name, ddl in schema.TABLES.items():
        df = tables.get(name)
        df = spark.createDataFrame([], ddl) if df is None else df.select(*(F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], ddl).schema))
        out = df.write.mode("overwrite")
        (out.partitionBy("time") if partition and "time" in df.columns else out).parquet(f"{path}/{name}")
    line = json.dumps({"hemisphere": "north"} | (meta or {}), default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A missing table raises FileNotFoundError."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(f"{path}/{name}")
    except AnalysisException as e:
        raise FileNotFoundError(f"{path}/{name} holds no Parquet files") from e
    return spark.read.schema(schema.TABLES[name]).parquet(f"{path}/{name}")


def load_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])
