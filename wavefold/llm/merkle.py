"""Merkle dataset manifest as a postorder append log.

Rows are leaves, leaves of one group form a tree, and the groups' roots form the tree of the whole. Two consecutive nodes
of a level give one of the next, a last one alone gives one by itself. The log holds the nodes of each tree in the
order in which they are complete: with a leaf comes every node that ends with it. Node ``idx`` of ``level`` begins at leaf
a = idx * 2^level; before a, 2a - ones(a) nodes are complete, and its own subtree of c leaves has the sum of
ceil(c / 2^m), m <= level, nodes, itself the last. So positions need no pointers.

Builders are aligned: one takes BLOCK leaves that begin at a multiple of BLOCK and writes all nodes inside them; their
tops are the leaves of the next tier's builders. A tier's part of the log holds the levels whose siblings its entries
need, so a proof reads one part of each tier, and finds siblings there by their positions. Leaves get their places from
a range partitioning and the row counts of its parts; no group, tree or log passes through one task.

Edge cases: nulls count in digests as ``-``; rows without an order value come first, rows without a group form one of
their own; rows of one order value follow by digest, and repeated rows are leaves of their own; an empty table has no
trees, no root and no rows. Columns that are not asked for take no part, whatever their names are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import materialise

#: A builder takes 2^BITS entries.
BITS = 12
BLOCK = 1 << BITS
#: The tree of the groups' roots; groups have trees 1, 2, ...
ROOT = 0


def digest(*columns: Column) -> Column:
    """SHA-256 (32 bytes) of the columns' values in turn: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(part, columns)).cast("binary"), 256))


def _h(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    return max(n - 1, 0).bit_length()


def position(level: np.ndarray | int, idx: np.ndarray, n: int) -> np.ndarray:
    """Place in the log of node ``idx`` of ``level`` in a tree of n leaves."""
    idx = np.asarray(idx, np.int64)
    level = np.broadcast_to(np.asarray(level, np.int64), idx.shape)
    a = idx << level
    count = np.minimum((idx + 1) << level, n) - a
    out = 2 * a - np.bitwise_count(a) - 1
    for m in range(int(level.max(initial=0)) + 1):
        out += np.where(m <= level, -(-count >> m), 0)
    return out


@dataclass
class Manifest:
    """``leaves``: tree, idx, leaf and carried columns; ``log``: tree, tier, block, level, idx, pos, digest; ``trees``:
    tree, grp, n; ``root``: the digest of the whole in hex, null where there are no leaves; ``groups``: how many trees."""

    leaves: DataFrame
    log: DataFrame
    trees: DataFrame
    root: str | None
    groups: int


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (grp, ord, leaf, own) with tree and idx in place of grp and ord, and the trees (tree, grp, n)."""
    # a row's number makes equal rows of a key split like others; written, so that it stays the same
    rows = materialise(rows.withColumn("nth", F.monotonically_increasing_id()), "digests")
    order = ["grp", "ord", "leaf", "nth"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialise(parts.drop("nth", "ord").withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "sorted")
    seen = materialise(parts.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("nth").alias("first")), "parts")
    # each group's number: those that begin in earlier parts, and those before it in the part where it begins
    begins = seen.groupBy("grp").agg(F.min("part").alias("part"), F.sum("n").alias("total"))
    per = begins.groupBy("part").agg(F.count("*").alias("new"))  # a row for each part of the partitioning
    before = per.select("part", (F.sum("new").over(Window.orderBy("part")) - F.col("new")).alias("before"))
    tree = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("grp"))
    trees = materialise(begins.join(before, "part").select(tree.cast("long").alias("tree"), "grp", F.col("total").alias("n")), "trees")
    offset = F.sum("n").over(Window.partitionBy("grp").orderBy("part")) - F.col("n")
    at = seen.withColumn("offset", offset).withColumnRenamed("grp", "g").join(trees.drop("n"), F.col("g").eqNullSafe(F.col("grp"))).select("part", "g", "tree", (F.col("offset") - F.col("first")).alias("shift"))
    at = materialise(at, "shifts")
    placed = parts.join(at, (parts["part"] == at["part"]) & parts["grp"].eqNullSafe(at["g"])).select("tree", (F.col("nth") + F.col("shift")).alias("idx"), "leaf", "own")
    return materialise(placed.withColumn("block", F.shiftright("idx", BITS)), "leaves"), trees


_NODE = "tree long, tier int, block long, level int, idx long, pos long, digest binary"


def _builder(tier: int):
    """The nodes of a block of a tier's entries (tree, block, idx, n, digest), in the order of their completion."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n, low = int(pdf["n"].iloc[0]), tier * BITS
        level, first = low, int(pdf["idx"].iloc[0])
        nodes = [d.hex().encode() for d in pdf["digest"]]
        out = [(level, first, nodes)] if tier == 0 else []
        while level < min(low + BITS, depth(n)):
            nodes = [_h(b"".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
            level, first = level + 1, first >> 1
            out.append((level, first, nodes))
        if not out:
            return pd.DataFrame(columns=[c.split()[0] for c in _NODE.split(", ")])
        levels = np.concatenate([np.full(len(x), at) for at, _, x in out])
        idx = np.concatenate([np.arange(begin, begin + len(x)) for _, begin, x in out])
        found = pd.DataFrame({"tree": key[0], "tier": levels // BITS, "block": idx >> (BITS - levels % BITS), "level": levels, "idx": idx, "pos": position(levels, idx, n), "digest": [bytes.fromhex(d.decode()) for _, _, x in out for d in x]})
        return found.sort_values("pos")

    return run


def _build(entries: DataFrame, largest: int) -> DataFrame:
    """The log of trees whose leaves are ``entries`` (tree, idx, n, digest)."""
    log = None
    for tier in range(max(1, -(-depth(largest) // BITS))):
        nodes = entries.withColumn("block", F.shiftright("idx", BITS)).groupBy("tree", "block").applyInPandas(_builder(tier), _NODE)
        nodes = materialise(nodes, "log")
        log = nodes if log is None else log.unionByName(nodes)
        # tops that are not yet their tree's
        entries = nodes.filter(F.col("level") == (tier + 1) * BITS).select("tree", "idx", "digest").join(entries.select("tree", "n").distinct().filter(F.col("n") > 1 << (tier + 1) * BITS), "tree")
    return log


def _tops(log: DataFrame, trees: DataFrame) -> DataFrame:
    """Each tree's root (tree, n, digest): its last node in the log."""
    last = log.filter("idx = 0").groupBy("tree").agg(F.max_by("digest", "pos").alias("digest"))
    return trees.select("tree", "n").join(last, "tree")


def build(rows: DataFrame, leaf: Column, group: Column, order: Column, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``rows``: ``leaf`` is a row's digest, ``group`` its tree, ``order`` its place there. The columns
    ``carry`` stay with the leaves in a struct ``own``."""
    own = F.struct(*(c.alias(k) for k, c in {"leaf": leaf, **(carry or {})}.items()))
    leaves, trees = _placed(rows.select(group.alias("grp"), order.alias("ord"), leaf.alias("leaf"), own.alias("own")))
    groups, largest = trees.agg(F.count("*"), F.max("n")).first()
    log = _build(leaves.select("tree", "idx", F.col("leaf").alias("digest")).join(trees.select("tree", "n"), "tree"), largest or 0)
    subroots = materialise(_tops(log, trees).select(F.lit(ROOT).cast("long").alias("tree"), (F.col("tree") - 1).alias("idx"), F.lit(groups).cast("long").alias("n"), "digest"), "subroots")
    log = log.unionByName(_build(subroots, groups))
    # the last of the root tree's nodes
    top = log.filter(F.col("tree") == ROOT).agg(F.max_by(F.lower(F.hex("digest")), "pos")).first()[0]
    return Manifest(leaves, log, trees, top, groups)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _extractor(tier: int):
    """For each entry of a block the siblings from the tier's part of the log, and those of the block above."""

    def run(entries: pa.Table, nodes: pa.Table) -> pa.Table:
        pos, kept = nodes["pos"].to_numpy(), nodes["digest"].to_pylist()
        order = np.argsort(pos)
        n, idx = entries["n"][0].as_py(), entries["idx"].to_numpy()
        # the row at -1 is the block's own, from above; each digest has 32 bytes
        top, rest = kept[order[0]], nodes["path"][int(order[0])].as_py()
        pos, data = pos[order[1:]], np.frombuffer(b"".join([kept[i] for i in order[1:]]), np.uint8).reshape(-1, 32)
        levels = range(tier * BITS, min((tier + 1) * BITS, depth(n)))
        found, there = np.zeros((len(idx), len(levels), 32), np.uint8), np.zeros((len(idx), len(levels)), bool)
        for i, level in enumerate(levels):
            other = (idx >> (level - tier * BITS)) ^ 1
            there[:, i] = other << level < n
            rows = np.flatnonzero(there[:, i])
            found[rows, i] = data[np.searchsorted(pos, position(level, other[rows], n))]
        paths = [f[t].tobytes() + rest for f, t in zip(found, there, strict=True)]
        more = [pa.array([top] * len(idx), pa.binary()), pa.array(paths, pa.binary())]
        return pa.table([*(entries[c] for c in ("tree", "idx", "n", "own")), *more], names=["tree", "idx", "n", "own", "subroot", "path"])

    return run


def _extend(entries: DataFrame, log: DataFrame, above: DataFrame, tier: int) -> DataFrame:
    """``entries`` (tree, idx, n, own) with their paths; ``above`` (tree, block, digest, path) has the rest of each block's."""
    own = entries.schema["own"].dataType.simpleString()
    log = log.filter(F.col("tier") == tier).select("tree", "block", "pos", "digest", F.lit(None).cast("binary").alias("path"))
    right = log.unionByName(above.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "digest", "path"))
    left = entries.withColumn("block", F.shiftright("idx", BITS))
    right = right.join(left.select("tree", "block").distinct(), ["tree", "block"], "left_semi")
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(_extractor(tier), f"tree long, idx long, n long, own {own}, subroot binary, path binary")


def _paths(wanted: DataFrame, log: DataFrame, tops: DataFrame, largest: int) -> DataFrame:
    """Paths of ``wanted`` (tree, idx, n, own) through their trees and then as ``tops`` (tree, digest, path) says."""
    tiers = max(1, -(-depth(largest) // BITS))
    # the entries of each tier that lie on a way up
    ways = [wanted]
    for tier in range(1, tiers):
        up = ways[-1].select("tree", F.shiftright("idx", BITS).alias("idx"), "n").filter(F.col("n") > 1 << tier * BITS).distinct()
        ways.append(materialise(up.withColumn("own", F.struct(F.lit(0).alias("x"))), "ways"))
    above = None
    for tier in reversed(range(tiers)):
        here = ways[tier]
        ends = here.filter(F.col("n") <= 1 << (tier + 1) * BITS) if tier + 1 < tiers else here
        # a tree that ends in this tier has one block here
        block = ends.select("tree").distinct().join(tops, "tree").select("tree", F.lit(0).cast("long").alias("block"), "digest", "path")
        above = block if above is None else block.unionByName(above)
        found = _extend(here, log, above, tier)
        if tier:
            found = materialise(found, "paths")
            above = found.select("tree", F.col("idx").alias("block"), F.col("subroot").alias("digest"), "path")
    return found


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """For the leaves ``wanted`` (rows of ``manifest.leaves``; all by default): tree, idx, n (leaves of the tree), groups,
    own, subroot and path, the siblings' digests one after the other up to the root."""
    log, trees = manifest.log, manifest.trees
    wanted = (manifest.leaves if wanted is None else wanted).join(trees.select("tree", "n"), "tree").select("tree", "idx", "n", "own")
    largest = trees.agg(F.max("n")).first()[0] or 0
    whole = _tops(log, trees.select("tree", "n")).withColumnRenamed("digest", "top")
    subroots = whole.select(F.lit(ROOT).cast("long").alias("tree"), (F.col("tree") - 1).alias("idx"), F.lit(manifest.groups).cast("long").alias("n"), F.struct("tree", "top").alias("own"))
    end = wanted.sparkSession.createDataFrame([(ROOT, bytes.fromhex(manifest.root or ""), b"")], "tree long, digest binary, path binary")
    tops = materialise(_paths(subroots, log.filter(F.col("tree") == ROOT), end, manifest.groups).select("own.tree", F.col("own.top").alias("digest"), "path"), "tops")
    return _paths(wanted, log.filter(F.col("tree") != ROOT), tops, largest).withColumn("groups", F.lit(manifest.groups).cast("long"))


def _climb(node: bytes, path: bytes, at: int, idx: int, n: int) -> tuple[bytes, int]:
    while n > 1:
        if idx ^ 1 >= n:
            node = _h(node)
        else:
            other, at = path[at : at + 32].hex().encode(), at + 32
            node = _h(other + node if idx & 1 else node + other)
        idx, n = idx >> 1, (n + 1) >> 1
    return node, at


def folded(leaf: Column, path: Column, idx: Column, n: Column, tree: Column, groups: Column) -> Column:
    """The root in hex that a leaf and its path give, from nothing but the leaf's place."""

    @F.pandas_udf("string")
    def fold(leaf: pd.Series, path: pd.Series, idx: pd.Series, n: pd.Series, tree: pd.Series, groups: pd.Series) -> pd.Series:
        out = []
        for d, p, i, m, t, g in zip(leaf, path, idx, n, tree, groups, strict=True):
            node, at = _climb(d.hex().encode(), p, 0, i, m)
            out.append(_climb(node, p, at, t - 1, g)[0].decode())
        return pd.Series(out, dtype=object)

    return fold(leaf, path, idx, n, tree, groups)
