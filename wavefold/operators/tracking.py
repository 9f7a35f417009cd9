"""Packets through time: overlap of energy rasters, pruning, heaviest disjoint tracks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import geo


def feature_energies(cells: DataFrame) -> DataFrame:
    """Energy of each label; 0 is background."""
    return cells.filter("rwp_id <> 0").groupBy("time", "rwp_id").agg(F.sum("energy").alias("energy"))


def overlaps(cells: DataFrame) -> DataFrame:
    """(time_to, feat_from, feat_to, overlap): sums of the root of both energies over shared cells of adjacent steps."""
    live = cells.filter("rwp_id <> 0")
    prev = live.select((F.col("time") + 1).alias("time"), "row", "col", F.col("rwp_id").alias("feat_from"), F.col("energy").alias("e_from"))
    # cells of all steps do not go through the driver, however few bytes their files are
    both = live.join(prev.hint("merge"), ["time", "row", "col"])
    sums = both.groupBy(F.col("time").alias("time_to"), "feat_from", F.col("rwp_id").alias("feat_to")).agg(F.sum(F.sqrt(F.col("e_from") * F.col("energy"))).alias("overlap"))
    return sums.filter("overlap > 0")


def edges(cells: DataFrame, places: DataFrame) -> DataFrame:
    """Tracking edges in the catalogue's form. ``places`` has (time, rwp_id, lon, lat)."""
    e = feature_energies(cells)
    a = e.select((F.col("time") + 1).alias("time_to"), F.col("rwp_id").alias("feat_from"), F.col("energy").alias("ea"))
    b = e.select(F.col("time").alias("time_to"), F.col("rwp_id").alias("feat_to"), F.col("energy").alias("eb"))
    w = overlaps(cells).join(a, ["time_to", "feat_from"]).join(b, ["time_to", "feat_to"]).filter(F.greatest("ea", "eb") > 0)
    w = w.withColumn("weight", F.col("overlap") / F.greatest("ea", "eb"))
    p = places.select((F.col("time") + 1).alias("time_to"), F.col("rwp_id").alias("feat_from"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    q = places.select(F.col("time").alias("time_to"), F.col("rwp_id").alias("feat_to"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    w = w.join(p, ["time_to", "feat_from"]).join(q, ["time_to", "feat_to"])
    before = F.col("time_to") - 1
    return w.select(geo.key(before, "feat_from").alias("src"), geo.key("time_to", "feat_to").alias("dst"), before.alias("time_from"), "feat_from", "time_to", "feat_to", "weight", geo.haversine_km("lat1", "lon1", "lat2", "lon2").alias("distance"))


def prune(track_edges: DataFrame, max_km: float | None = 8000.0, min_weight: float | None = None) -> DataFrame:
    """Distance strictly below, weight at least; None switches a gate off."""
    out = track_edges
    out = out if max_km is None else out.filter(F.col("distance") < max_km)
    return out if min_weight is None else out.filter(F.col("weight") >= min_weight)


def merges(track_edges: DataFrame) -> DataFrame:
    return track_edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def splits(track_edges: DataFrame) -> DataFrame:
    return track_edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


#: So many steps of time are settled in one task.
BLOCK = 256
_NONE = float("-inf")


def _walk(edges: list[tuple[str, str, float]], start: dict[str, float]) -> dict[str, tuple[float, str]]:
    """{vertex: (weight of the heaviest path into it, vertex before)} along edges in order of time; ``start`` has what
    paths weigh at the vertices where they may begin, others begin with nothing. Ties go to the smaller vertex before."""
    best: dict[str, tuple[float, str]] = {}
    for src, dst, w in edges:
        base = best[src][0] if src in best else start.get(src, 0.0)
        if base > _NONE and base + w > 0 and (dst not in best or (base + w, best[dst][1]) > (best[dst][0], src)):
            best[dst] = (base + w, src)
    return best


def _in_order(pdf) -> list[tuple[str, str, float]]:
    pdf = pdf.sort_values(["time_to", "dst", "src"])
    return list(zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True))


def _across(key, pdf, block: int):
    """Of one block: the heaviest way from each vertex of its first step to each of the next one's (from, to, weight), and
    the heaviest that begins inside (from null)."""
    edges = _in_order(pdf)
    begin = sorted(set(pdf.loc[pdf["time_to"] == key[0] * block + 1, "src"]))
    ends = sorted(set(pdf.loc[pdf["time_to"] == (key[0] + 1) * block, "dst"]))
    out = [(None, k, x[0]) for k in ends if (x := _walk(edges, {}).get(k))]
    nowhere = {src: _NONE for src, _, _ in edges}
    for b in begin:
        found = _walk(edges, nowhere | {b: 0.0})
        out += [(b, k, found[k][0]) for k in ends if k in found]
    return pd.DataFrame(out, columns=["src", "dst", "weight"]).assign(block=key[0])[["block", "src", "dst", "weight"]]


def _entries(track_edges: DataFrame, save, block: int) -> DataFrame:
    """(key, start): what the heaviest path into each vertex weighs that begins a block, but for those of the first. The
    blocks are contracted to edges from one's first step to the next one's, and these settled the same way."""
    at = track_edges.withColumn("block", F.floor((F.col("time_to") - 1) / block))
    across = save(at.groupBy("block").applyInPandas(lambda key, pdf: _across(key, pdf, block), "block long, src string, dst string, weight double"))
    # an edge for each way, a step of time for each block; what begins inside comes from a vertex of its own
    inside = F.concat(F.lit("block "), F.col("block"))
    coarse = across.select(F.coalesce("src", inside).alias("src"), "dst", (F.col("block") + 1).alias("time_to"), "weight")
    return best_into(coarse, save, block).filter("before IS NOT NULL").select("key", F.col("best").alias("start"))


def best_into(track_edges: DataFrame, save, block: int = BLOCK) -> DataFrame:
    """For each vertex the weight of the heaviest path into it and the vertex before on it; ties to the smaller key.
    Edges lead from each time step to the next. Blocks of time are settled each in a task of their own, once it is known
    what comes into them, which is settled first, on blocks as steps of a coarser graph: for n steps of time there are
    log n rounds of tasks, and a task holds ``block`` steps."""
    first, last = track_edges.agg(F.min("time_to"), F.max("time_to")).first()
    ends = track_edges.select(F.col("src").alias("key")).union(track_edges.select("dst")).distinct()
    if first is None:
        return ends.select("key", F.lit(0.0).alias("best"), F.lit(None).cast("string").alias("before"))
    rows = track_edges.select("src", "dst", "time_to", "weight", F.lit(None).cast("double").alias("start"))
    number = F.floor((F.col("time_to") - 1) / block).alias("block")
    if (last - 1) // block > (first - 1) // block:
        come = _entries(track_edges.select("src", "dst", "time_to", "weight"), save, block)
        begin = track_edges.filter(F.pmod(F.col("time_to") - 1, F.lit(block)) == 0).select("src", "time_to").distinct()
        known = come.join(begin, come["key"] == begin["src"]).select("src", F.lit(None).cast("string").alias("dst"), "time_to", F.lit(0.0).alias("weight"), "start")
        rows = rows.unionByName(known)

    def run(pdf):
        mark = pdf["dst"].isna()
        found = _walk(_in_order(pdf[~mark]), dict(zip(pdf.loc[mark, "src"], pdf.loc[mark, "start"], strict=True)))
        return pd.DataFrame([(k, w, b) for k, (w, b) in found.items()], columns=["key", "best", "before"])

    done = rows.groupBy(number).applyInPandas(run, "key string, best double, before string")
    return ends.join(done, "key", "left").select("key", F.coalesce("best", F.lit(0.0)).alias("best"), "before")


def track_paths(track_edges: DataFrame, save=lambda df: df.checkpoint(), *, block: int = BLOCK) -> DataFrame:
    """Vertex-disjoint heaviest tracks (track_id, pos, key).

    The heaviest path into each sink is a candidate; of candidates that share a vertex the heavier stays (ties: the
    smaller sink). Each vertex has one before it, so that candidates that share a vertex share all before it: those of one
    root are rivals of each other and of no others, and the heaviest of each root is what taking one at a time would
    choose. Ways back are doubled in each round. ``save`` cuts lineage."""
    best = save(best_into(track_edges, save, block))
    jumps = jumps_back(best, save)
    sinks = best.join(track_edges.select(F.col("src").alias("key")).distinct(), "key", "left_anti").filter(F.col("before").isNotNull())
    roots = sinks.select(F.col("key").alias("sink"), F.col("best").alias("weight"), "key")
    for j in reversed(jumps[:-1]):
        roots = roots.join(j, "key", "left").select("sink", "weight", F.coalesce("to", "key").alias("key"))
    chosen = save(roots.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "sink")).alias("x")).select("x.sink", (-F.col("x.w")).alias("weight")))
    return _numbered(chosen, jumps, save)


def as_rows(chosen: DataFrame, best: DataFrame, save=lambda df: df.checkpoint()) -> DataFrame:
    """(track_id, pos, key) of the tracks that end at ``chosen`` (sink, weight), from the vertices before (key, before)."""
    return _numbered(chosen, jumps_back(best, save), save)


def jumps_back(best: DataFrame, save) -> list[DataFrame]:
    """(key, to): ways back by 1, 2, 4, ... vertices, the last one empty."""
    jumps = [save(best.filter("before IS NOT NULL").select("key", F.col("before").alias("to")))]
    while not jumps[-1].isEmpty():
        again = jumps[-1].select(F.col("key").alias("to"), F.col("to").alias("next"))
        jumps.append(save(jumps[-1].join(again, "to").select("key", F.col("next").alias("to"))))
    return jumps


def _numbered(chosen: DataFrame, jumps: list[DataFrame], save) -> DataFrame:
    rows = chosen.select("sink", F.col("sink").alias("key"), F.lit(0).alias("back"))
    for i, j in reversed(list(enumerate(jumps[:-1]))):
        rows = save(rows.unionByName(rows.join(j, "key").select("sink", F.col("to").alias("key"), (F.col("back") + (1 << i)).alias("back"))))
    sizes = rows.groupBy("sink").agg(F.max("back").alias("length")).join(chosen, "sink")
    parts = sizes.withColumn("part", F.floor(-F.col("weight"))).groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # a row for each whole weight
    ids = sizes.withColumn("part", F.floor(-F.col("weight"))).join(before, "part")
    ids = ids.withColumn("track_id", F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("weight").desc(), "sink")) - 1)
    return rows.join(ids.select("sink", "track_id", "length"), "sink").select("track_id", (F.col("length") - F.col("back")).cast("long").alias("pos"), "key")
