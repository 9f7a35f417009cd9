"""Overlaps from a stream of cells: equal to those in batch, in one batch or in many, with late and empty cells."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wavefold.operators import tracking
from wavefold.sources.staging import path
from wavefold.streaming import overlap, tracks

SCHEMA = "ts timestamp, row int, col int, rwp_id long, energy double"
DAY = datetime(2024, 1, 1)


def plain(cells):
    at, out = {(t, r, c): (p, e) for t, r, c, p, e in cells if p and e is not None}, {}
    for (t, r, c), (p, e) in at.items():
        if (t - timedelta(days=1), r, c) in at:
            q, f = at[t - timedelta(days=1), r, c]
            out[t, q, p] = out.get((t, q, p), 0.0) + math.sqrt(e * f)
    return {k: v for k, v in out.items() if v > 0}


def run(spark, files):
    """Rows of the stream of these files, one file for each batch."""
    source, out = path(spark, "cells"), path(spark, "overlaps")
    for f in files:
        f.coalesce(1).write.mode("append").parquet(source)
    stream = overlap.overlap_edges(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    rows = [((r["ts"], r["feat_from"], r["feat_to"]), r["overlap"]) for r in spark.read.schema(stream.schema).parquet(out).collect()]
    # each pair comes out once
    assert len(rows) == len(dict(rows))
    return dict(rows)


def same(a, b):
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)


def test_stream_equals_batch(spark):
    rand = random.Random(7)
    cells = [(DAY + timedelta(days=t), r, c, rand.randint(0, 3), rand.choice([0.0, 1.0, 9.0, 2.5])) for t in range(8) for r in range(4) for c in range(4) if rand.random() < 0.8]
    table = spark.createDataFrame(cells, SCHEMA)
    want = plain(cells)
    batch = tracking.overlaps(table.select(F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("time"), "row", "col", "rwp_id", "energy"))
    same({(DAY + timedelta(days=r["time_to"]), r["feat_from"], r["feat_to"]): r["overlap"] for r in batch.collect()}, want)
    end = overlap.end_mark(table)
    same(run(spark, [table, end]), want)
    # day by day, and each day's odd rows with the day after
    same(run(spark, [*(table.filter(F.datediff("ts", F.lit("2024-01-01")) == t) for t in range(8)), end]), want)
    same(run(spark, [*(table.filter(F.datediff("ts", F.lit("2024-01-01")) + F.col("row") % 2 == t) for t in range(9)), end]), want)


def test_late_null_and_no_cells(spark):
    cells = [(DAY + timedelta(days=t), 0, 0, 1, 4.0) for t in range(3)]
    table = spark.createDataFrame([*cells, (DAY, 1, 1, None, 4.0), (DAY + timedelta(days=1), 1, 1, 2, 4.0), (DAY, 2, 2, 3, None), (None, 0, 0, 1, 4.0)], SCHEMA)
    later, more = (spark.createDataFrame([(DAY + timedelta(days=d), 0, 0, 1, 4.0)], SCHEMA) for d in (30, 40))
    late = spark.createDataFrame([(DAY + timedelta(days=1), 0, 0, 9, 4.0)], SCHEMA)
    want = {(DAY + timedelta(days=t), 1, 1): 4.0 for t in (1, 2)}
    same(run(spark, [table, later, more, late, overlap.end_mark(more)]), want)
    none = table.limit(0)
    assert overlap.end_mark(none).collect() == []
    same(run(spark, [none, none]), {})


def graph(seed, steps, wide):
    """Edges (time_to, src, dst, weight) between some of the vertices of adjacent steps; some steps have none."""
    rand = random.Random(seed)
    for t in range(1, steps):
        for i in range(wide):
            for j in range(wide):
                if t % 11 and rand.random() < 1.2 / wide:
                    yield t, f"{t - 1}:{i}", f"{t}:{j}", rand.choice([0.25, 0.5, 0.75])


def rows_of(df):
    return {(r["track_id"], r["pos"], r["key"]) for r in df.collect()}


def test_streamed_tracks_equal_those_of_batch(spark):
    """In one batch, in batches of a few steps, with steps that wait, and with a batch that is repeated."""
    table = spark.createDataFrame(list(graph(1, 18, 5)), tracks.EDGE)
    want = rows_of(tracking.track_paths(table))
    assert len({r[0] for r in want}) > 4
    for cut, delay in ((100, 0), (6, 1)):
        folder, sizes = path(spark, "tracks"), []
        tracks.begin(spark, folder)
        parts = [table.filter(F.col("time_to").between(t, t + cut - 1)) for t in range(0, 18, cut)]
        for i, part in enumerate([*parts, tracks.end_mark(table, delay)]):
            for _ in range(2 if i == 1 else 1):
                tracks.step(part, i, folder, delay)
            sizes.append([spark.read.schema(schema).parquet(f"{folder}/state{i % 2}/{name}").count() for name, schema in tracks.STATE.items()])
        assert rows_of(tracks.tracks(spark, folder)) == want
        # no more than the live step's vertices, their roots and the steps that wait, and in the end nothing
        assert sizes[-1] == [0, 0, 0, 1]
        assert cut == 100 or all(live <= 5 and heads <= live for _, live, heads, _ in sizes)
        assert spark.read.schema(tracks.EDGE).parquet(f"{folder}/late").count() == 0


def test_streamed_tracks_go_on_and_set_late_edges_apart(spark):
    edges = list(graph(2, 12, 3))
    table = spark.createDataFrame(edges, tracks.EDGE)
    odd = [(1, None, "1:0", 1.0), (2, "1:0", None, 1.0), (3, "2:0", "3:0", None), (None, "2:0", "3:0", 1.0)]
    source, folder = path(spark, "edges"), path(spark, "tracks")
    parts = [table.filter("time_to <= 6").unionByName(table.filter("time_to <= 6")), spark.createDataFrame([*odd, *(e for e in edges if e[0] > 6)], tracks.EDGE), spark.createDataFrame([(2, "1:0", "2:2", 99.0)], tracks.EDGE), tracks.end_mark(table)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        tracks.follow(spark.readStream.schema(tracks.EDGE).parquet(source), folder).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(tracks.tracks(spark, folder)) == rows_of(tracking.track_paths(table))
    assert [tuple(r) for r in spark.read.schema(tracks.EDGE).parquet(f"{folder}/late").drop("batch").collect()] == [(2, "1:0", "2:2", 99.0)]
    nothing = path(spark, "none")
    tracks.begin(spark, nothing)
    tracks.step(table.limit(0), 0, nothing)
    assert tracks.end_mark(table.limit(0)).collect() == [] and tracks.tracks(spark, nothing).collect() == []
