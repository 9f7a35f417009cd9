"""Sharding by a k-d tree over metadata.

The rows are split again and again, at the distributed weighted median (or other share) of the dimension that is widest
in its node, until each leaf holds about the target bytes. A dimension's values become whole numbers whose last bits are
a hash of the row, so that equal values can be split too; the median is found digit by digit from sums of bytes per
digit, for all nodes of a level at once. Rows carry their node, and a level's splits are a table that they are joined
with, so that neither plan nor driver holds a tree, however many shards there are.

Edge cases: null texts have no bytes (only ``overhead``), null metadata counts as 0; rows that are equal in everything
the hash sees go to one side; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Bits of a dimension's value, and of the hash below it; digits of so many bits are looked at in turn.
VALUE_BITS, HASH_BITS, DIGIT = 24, 36, 15
#: About so many rows are numbered together.
RUN = 50_000


def _scaled(value: Column, low: float, high: float, tie: Column) -> Column:
    """A value between ``low`` and ``high`` as VALUE_BITS bits, above HASH_BITS bits of the tie-breaker."""
    top = float((1 << VALUE_BITS) - 1)
    x = F.floor((value - F.lit(low)) * F.lit(top / (high - low) if high > low else 0.0)).cast("long")
    return F.shiftleft(x, HASH_BITS).bitwiseOR(tie)


#: Tables of at most so many nodes are sent to every task; larger ones are joined by shuffles.
SENT = 50_000


def _join(rows: DataFrame, nodes: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """``rows`` with what ``nodes`` (of which there are at most ``n``) say of the node of each."""
    return rows.join(F.broadcast(nodes) if n <= SENT else nodes, "first", how)


def split(rows: DataFrame, dims: list[str], size: str, shards: int) -> DataFrame:
    """``rows`` (with long dimensions from _scaled()) with a column first, the shard from 0 to shards - 1. A row carries its
    node: the first shard below it and the number of its leaves. A level of the tree is one plan: each open node's
    widest dimension and goal, the digits of its split, and each row's node below. The number of levels comes from
    that of shards; no part of the tree comes to the driver."""
    rows = rows.withColumn("first", F.lit(0)).withColumn("leaves", F.lit(shards))
    largest, open_ = shards, 1
    while largest > 1:
        # a node's leaves come from those of its parent alone, so that all tasks agree
        at = rows.filter("leaves > 1")
        ends = at.groupBy("first", "leaves").agg(F.sum(size).alias("bytes"), *(F.min(d).alias(f"low{i}") for i, d in enumerate(dims)), *(F.max(d).alias(f"high{i}") for i, d in enumerate(dims)))
        width = [F.struct((F.col(f"high{i}") - F.col(f"low{i}")).alias("w"), F.lit(-i).alias("i")) for i in range(len(dims))]
        half = F.floor(F.col("leaves") / 2)
        nodes = ends.select("first", (-F.greatest(*width)["i"]).alias("dim"), (F.col("bytes") * half / F.col("leaves")).alias("goal"), F.lit(0).cast("long").alias("prefix"))
        key = F.lit(None).cast("long")
        for i, d in enumerate(dims):
            key = F.when(F.col("dim") == i, F.col(d)).otherwise(key)
        for shift in range(VALUE_BITS + HASH_BITS - DIGIT, -1, -DIGIT):
            keyed = _join(at, nodes, open_).withColumn("key", key).filter(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
            sums = keyed.groupBy("first", "dim", "goal", F.shiftright("key", shift).alias("digit")).agg(F.sum(size).alias("bytes"))
            # the digit in which the goal lies, from at most 2 ** DIGIT sums a node
            cum = sums.withColumn("before", F.sum("bytes").over(Window.partitionBy("first").orderBy("digit")) - F.col("bytes")).filter(F.col("before") <= F.col("goal"))
            found = cum.groupBy("first", "dim", "goal").agg(F.max_by(F.struct("digit", "before"), "digit").alias("x"))
            nodes = found.select("first", "dim", (F.col("goal") - F.col("x.before")).alias("goal"), F.col("x.digit").alias("prefix"))
        # rows below the key that holds the goal go low; those of a leaf stay
        half = F.when(F.col("leaves") > 1, F.floor(F.col("leaves") / 2).cast("int")).otherwise(0)
        low = (F.col("leaves") > 1) & (key < F.col("prefix"))
        below = _join(rows, nodes, open_, "left").select(*(c for c in rows.columns if c not in ("first", "leaves")), F.when(low, F.col("first")).otherwise(F.col("first") + half).alias("first"), F.when(low, half).otherwise(F.col("leaves") - half).alias("leaves"))
        rows = materialise(below, "level")
        largest, open_ = largest - largest // 2, 2 * open_
    return rows.drop("leaves").withColumnRenamed("first", "shard")


def shard(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", words: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot. Give ``shards``, or ``target_bytes`` for each.
    Metadata are the columns ``words`` (those that exist), the size and the id."""
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    bytes_ = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + overhead
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), bytes_.alias("size"), crc.alias("text_crc32"), *(F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)).cast("double").alias(f"m{i}") for i, c in enumerate(w for w in words if w in docs.columns)))
    raw = materialise(raw, "metadata")
    metas = [c for c in raw.columns if c.startswith("m") and c[1:].isdigit()]
    values = [*(F.col(c) for c in metas), F.log1p("size"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))]
    ends = raw.agg(F.sum("size").alias("bytes"), *(F.min(v).alias(f"low{i}") for i, v in enumerate(values)), *(F.max(v).alias(f"high{i}") for i, v in enumerate(values))).first()
    if ends["bytes"] is None:
        ends = {"bytes": 0} | {f"{k}{i}": 0.0 for k in ("low", "high") for i in range(len(values))}
    if shards is None:
        shards = max(1, -(-ends["bytes"] // target_bytes))
    tie = F.xxhash64("doc_id", "text_crc32", "size").bitwiseAND(F.lit((1 << HASH_BITS) - 1).cast("long"))
    dims = [f"d{i}" for i in range(len(values))]
    rows = raw.select("doc_id", "size", "text_crc32", *(_scaled(v, ends[f"low{i}"], ends[f"high{i}"], tie).alias(d) for i, (v, d) in enumerate(zip(values, dims, strict=True))))
    rows = materialise(rows, "dimensions")
    placed = split(rows, dims, "size", shards).select("doc_id", "size", "text_crc32", "shard")
    return slots(placed, shards)


def slots(placed: DataFrame, shards: int) -> DataFrame:
    """A number from 0 without gaps for each row of a shard: rows are numbered in runs, behind the rows of the runs before."""
    n = placed.groupBy("shard").agg(F.ceil(F.count("*") / RUN).alias("runs"))  # a row for each shard
    run = F.pmod(F.xxhash64("doc_id", "text_crc32"), "runs")
    rows = placed.join(F.broadcast(n) if shards <= SENT else n, "shard").withColumn("run", run)
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).drop("n")
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(before, ["shard", "run"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))
