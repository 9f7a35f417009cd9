"""Tracking edges from a stream of raster cells: each time step is joined with the one before, within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def overlap_edges(cells: DataFrame, *, step: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(ts, feat_from, feat_to, overlap) of packets in adjacent steps, from cells (ts, row, col, rwp_id, energy) whose ts marks
    the step: a stream-stream join of the cells with themselves one step on, summed for each pair when the watermark has
    passed. State is the cells and pairs of the steps that ``delay`` holds open, however long the stream. Cells that
    come later than that are counted in the batch after the one that made them late at most; the last steps come out
    once a cell of a step beyond ``delay`` has come, such as that of ``end_mark``. Cells without a packet (0 or null) or
    energy overlap nothing."""
    own = cells.filter("ts IS NOT NULL")
    now = own.select("ts", "row", "col", F.col("rwp_id").alias("feat_to"), "energy").withWatermark("ts", delay)
    before = own.select((F.col("ts") + F.expr(f"INTERVAL {step}")).alias("ts_next"), F.col("row").alias("row_b"), F.col("col").alias("col_b"), F.col("rwp_id").alias("feat_from"), F.col("energy").alias("e_from")).withWatermark("ts_next", delay)
    both = now.join(before, (F.col("ts") == F.col("ts_next")) & (F.col("row") == F.col("row_b")) & (F.col("col") == F.col("col_b")))
    shared = both.filter("feat_from <> 0 AND feat_to <> 0 AND e_from IS NOT NULL AND energy IS NOT NULL")
    return shared.groupBy("ts", "feat_from", "feat_to").agg(F.sum(F.sqrt(F.col("e_from") * F.col("energy"))).alias("overlap")).filter("overlap > 0")


def end_mark(cells: DataFrame, after: str = "10 days") -> DataFrame:
    """A cell off the raster (-1 in all columns) so long after the last of ``cells`` (a table) that it meets none: appended
    to a stream's source, it ends the steps before it. Its columns are not null, as cells with nulls are left out before
    the watermark sees them."""
    last = cells.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts")).filter("ts IS NOT NULL")
    return last.select(*("ts" if f.name == "ts" else F.lit(-1).cast(f.dataType).alias(f.name) for f in cells.schema))
