"""Heaviest disjoint tracks from a stream of tracking edges, with what is live as the only state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..operators import tracking
from ..sources.staging import save

EDGE = "time_to long, src string, dst string, weight double"
#: Tables of a folder that grow: vertices as they are settled, tracks as they end, edges that came too late.
VERTEX, TRACK = "key string, time long, best double, before string, root string", "root string, sink string, weight double"
#: What the next batch goes on from: edges of steps that are not over, vertices of the last step that is, and for each
#: root of these the best end so far.
STATE = {"waiting": EDGE, "live": "key string, time long, best double, root string", "heads": TRACK, "mark": "batch long, done long, seen long"}
_BEFORE = -(1 << 62)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def begin(spark: SparkSession, folder: str) -> None:
    """Empty tables in ``folder``, unless it has some."""
    if _exists(spark, f"{folder}/state1/mark"):
        return
    for name, schema in {"vertices": VERTEX, "tracks": TRACK, "late": EDGE}.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}/batch=-1")
    for name, schema in STATE.items():
        rows = [(-1, _BEFORE, _BEFORE)] if name == "mark" else []
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/state1/{name}")


def _roots(best: DataFrame, live: DataFrame) -> DataFrame:
    """(key, root): the first vertex on the heaviest path into each, by ways back that double; from a live one its own."""
    jumps = tracking.jumps_back(best.filter("before <> ''"), save)
    tops = best.select(F.col("key").alias("end"), "key")
    for j in reversed(jumps[:-1]):
        tops = tops.join(j, "key", "left").select("end", F.coalesce("to", "key").alias("key"))
    return tops.join(live.select("key", "root"), "key", "left").select(F.col("end").alias("key"), F.coalesce("root", "key").alias("root"))


def step(batch: DataFrame, batch_id: int, folder: str, delay: int = 0) -> None:
    """Settle the time steps that are over with this batch. The state of the batch before is read, that of this one written
    beside it, and what it found to files of its number: a batch that is repeated writes the same once more."""
    spark = batch.sparkSession
    old, new = (f"{folder}/state{i % 2}" for i in (batch_id - 1, batch_id))
    waiting, live, heads, mark = (spark.read.schema(schema).parquet(f"{old}/{name}") for name, schema in STATE.items())
    last, done, seen = mark.first()
    if last != batch_id - 1:
        raise RuntimeError(f"{folder} has the state of batch {last}, not of {batch_id - 1}")
    came = save(batch.select("time_to", "src", "dst", "weight").filter("time_to IS NOT NULL"), "came")
    seen = max(seen, came.agg(F.coalesce(F.max("time_to"), F.lit(_BEFORE))).first()[0])
    over = max(done, seen - delay - 1)
    real = came.filter("src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL")
    open_ = waiting.unionByName(real.filter(F.col("time_to") > done))
    now = open_.filter(F.col("time_to") <= over)
    # what leads to a live vertex is an edge from nowhere
    known = live.select(F.col("time").alias("time_to"), F.lit("").alias("src"), F.col("key").alias("dst"), F.col("best").alias("weight"))
    edges = save(now.unionByName(known), "edges")
    best = save(tracking.best_into(edges, save).filter("key <> ''"), "best")
    times = edges.select(F.col("dst").alias("key"), F.col("time_to").alias("time")).unionByName(edges.select(F.col("src").alias("key"), (F.col("time_to") - 1).alias("time"))).groupBy("key").agg(F.max("time").alias("time"))
    vertices = save(best.join(times, "key").join(_roots(best, live), "key").select("key", "time", "best", "before", "root"), "vertices")
    reached = vertices.filter("before IS NOT NULL")
    ahead = reached.filter(F.col("time") == over).select("key", "time", "best", "root")
    ends = reached.filter(F.col("time") < over).join(edges.select(F.col("src").alias("key")).distinct(), "key", "left_anti")
    either = heads.unionByName(ends.select("root", F.col("key").alias("sink"), F.col("best").alias("weight")))
    either = either.groupBy("root").agg(F.min(F.struct((-F.col("weight")).alias("w"), "sink")).alias("x")).select("root", "x.sink", (-F.col("x.w")).alias("weight"))
    going = ahead.select("root").distinct()
    for name, table in {"vertices": vertices.filter("before IS NULL OR before <> ''"), "tracks": either.join(going, "root", "left_anti"), "late": real.filter(F.col("time_to") <= done)}.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
    state = {"waiting": open_.filter(F.col("time_to") > over), "live": ahead, "heads": either.join(going, "root", "left_semi"), "mark": spark.createDataFrame([(batch_id, over, seen)], STATE["mark"])}
    for name, table in state.items():
        table.write.mode("overwrite").parquet(f"{new}/{name}")


def follow(edges: DataFrame, folder: str, *, delay: int = 0) -> DataStreamWriter:
    """A writer of the stream ``edges`` (time_to, src, dst, weight; each edge leads from one time step to the next) that
    settles steps as they are over and keeps ``vertices``, ``tracks`` and ``late`` in ``folder``; trigger and start are the
    caller's. A stream that is started again with its folder goes on.

    A step is over when an edge, or a row of a time alone (see ``end_mark``), has come of one more than ``delay`` steps
    later. Its vertices then have the heaviest paths into them and these paths' roots. A track, the heaviest path from a
    root, ends when no path from its root is live. Memory and state are the live step and the steps that wait, however long
    the stream. Edges that come after their step was over are kept in ``late`` and count nowhere; edges without ends or
    weight are left out; a repeated edge counts once, as it adds no other path."""
    begin(edges.sparkSession, folder)
    return edges.writeStream.foreachBatch(lambda batch, i: step(batch, i, folder, delay)).option("checkpointLocation", f"{folder}/progress")


def end_mark(edges: DataFrame, delay: int = 0) -> DataFrame:
    """A row of a time so late that with it all steps of ``edges`` (a table) are over and nothing is live."""
    last = edges.agg((F.max("time_to") + delay + 2).alias("time_to")).filter("time_to IS NOT NULL")
    return last.select(*("time_to" if f.name == "time_to" else F.lit(None).cast(f.dataType).alias(f.name) for f in edges.schema))


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    """The tracks that have ended so far (track_id, pos, key), heaviest first, as ``tracking.track_paths`` has them."""
    ended = save(spark.read.schema(TRACK).parquet(f"{folder}/tracks"), "ended")
    return tracking.as_rows(ended.select("sink", "weight"), spark.read.schema(VERTEX).parquet(f"{folder}/vertices").select("key", "before"), save)
