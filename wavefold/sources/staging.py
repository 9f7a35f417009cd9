"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What a table takes in memory, in sizes of its files: they are compressed, and rows are widened before joins.
WIDER = 32.0


def sized(spark: SparkSession) -> None:
    """Plans reckon with tables as they are in memory. By the size of its files a table of many rows may look small enough to
    be sent through the driver to all executors; now that is done only if a shuffle has shown it to be small."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(WIDER))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as the session asks for, before groups that are few bytes and much work:
    tasks that are joined up to a number of bytes would do such work one group after the other."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session may leave it unset and gets a new local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="wavefold-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once to such a path and read again: what follows starts from the files, whatever executors are
    lost."""
    sized(df.sparkSession)
    to = path(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
