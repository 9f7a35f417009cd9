"""The Merkle manifest, whitening and substring dedup against plain versions, on awkward and larger rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.llm import merkle, repeats, whitening

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_tree(leaves):
    """Root, the siblings of each leaf, and (level, idx) of the nodes in postorder."""
    paths, level, at = [""] * len(leaves), leaves, list(range(len(leaves)))
    levels = [leaves]
    while len(level) > 1:
        for j, i in enumerate(at):
            paths[j] += level[i ^ 1] if i ^ 1 < len(level) else ""
        level = [H("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
        levels.append(level)

    def walk(depth, i):
        if depth:
            for c in (2 * i, 2 * i + 1):
                if c < len(levels[depth - 1]):
                    yield from walk(depth - 1, c)
        yield depth, i, levels[depth][i]

    return level[0], paths, list(walk(len(levels) - 1, 0))


def plain_manifest(rows):
    """{(id, leaf): [(subroot, root, path)]} for rows (id, group, leaf)."""
    key = lambda x: (x is not None, x)
    groups = defaultdict(list)
    for doc, group, leaf in rows:
        groups[group].append((doc, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[1] for x in sorted(groups[g], key=lambda x: (*key(x[0]), x[1]))]) for g in order}
    root, up, _ = plain_tree([trees[g][0] for g in order])
    out = Counter()
    for g, rest in zip(order, up, strict=True):
        for (doc, leaf), path in zip(sorted(groups[g], key=lambda x: (*key(x[0]), x[1])), trees[g][1], strict=True):
            out[doc, leaf, trees[g][0], root, path + rest] += 1
    return out


def proofs(df, columns, group, order):
    whole = merkle.build(df, merkle.digest(*map(F.col, columns)), F.col(group), F.col(order), {"id": F.col(order)})
    found = merkle.prove(whole)
    root = merkle.folded(F.col("own.leaf"), F.col("path"), F.col("idx"), F.col("n"), F.col("tree"), F.col("groups"))
    hexed = lambda c: F.lower(F.hex(c))
    rows = found.select("own.id", hexed("own.leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("path").alias("path"), root.alias("folded")).collect()
    assert all(r["folded"] == whole.root for r in rows)
    return whole, Counter((r["id"], r["leaf"], r["subroot"], whole.root, r["path"]) for r in rows)


def test_manifest_of_awkward_rows(spark, docs, empty):
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = plain_manifest([(r["doc_id"], r["lang"], H("".join(part(r[c]) for c in cols))) for r in docs.collect()])
    assert proofs(docs, cols, "lang", "doc_id")[1] == want
    whole, none = proofs(empty, cols, "lang", "doc_id")
    assert none == Counter() and whole.root is None and whole.log.collect() == []


@pytest.mark.parametrize(("bits", "n"), [(12, 9000), (2, 300)])
def test_manifest_of_several_tiers_and_the_log_s_order(spark, monkeypatch, bits, n):
    """A group that holds most rows, groups of one row, many groups; ids that repeat."""
    monkeypatch.setattr(merkle, "BITS", bits)
    df = spark.range(n).selectExpr("id - id % 3 AS id", "CASE WHEN id % 5 > 0 THEN 'a' WHEN id % 50 > 0 THEN 'é' WHEN id % 100 > 0 THEN concat('z', id) END AS g", "id % 11 AS x")
    rows = [(r["id"], r["g"], H(f"{len(str(r['id']))}:{r['id']}{len(str(r['x']))}:{r['x']}")) for r in df.collect()]
    whole, got = proofs(df, ["id", "x"], "g", "id")
    assert got == plain_manifest(rows)
    log = defaultdict(list)
    for r in whole.log.collect():
        log[r["tree"]].append(r)
    for r in whole.trees.collect():
        leaves = [leaf for _, g, leaf in sorted(rows, key=lambda x: (x[0], x[2])) if g == r["grp"]]
        nodes = sorted(log[r["tree"]], key=lambda x: x["pos"])
        assert [x["pos"] for x in nodes] == list(range(len(nodes)))
        assert [(x["level"], x["idx"], x["digest"].hex()) for x in nodes] == plain_tree(leaves)[2]


def test_proofs_of_some_leaves(spark):
    df = spark.range(5000).selectExpr("id", "'g' AS g")
    whole = merkle.build(df, merkle.digest(F.col("id")), F.col("g"), F.col("id"), {"id": F.col("id")})
    some = merkle.prove(whole, whole.leaves.filter("own.id IN (0, 4095, 4096, 4999)")).select("own.id", "path").collect()
    everything = {r["id"]: r["path"] for r in merkle.prove(whole).select("own.id", "path").collect()}
    assert {r["id"]: r["path"] for r in some} == {i: everything[i] for i in (0, 4095, 4096, 4999)}


def test_tampered_leaves_do_not_fold_to_the_root(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'g' END AS g")
    bad = F.when(F.col("id") % 7 == 0, merkle.digest(F.col("id") + 1))
    whole = merkle.build(df, merkle.digest(F.col("id")), F.col("g"), F.col("id"), {"id": F.col("id"), "bad": bad})
    root = merkle.folded(F.coalesce("own.bad", "own.leaf"), F.col("path"), F.col("idx"), F.col("n"), F.col("tree"), F.col("groups"))
    assert all((r["folded"] == whole.root) == (r["id"] % 7 > 0) for r in merkle.prove(whole).select("own.id", root.alias("folded")).collect())


def check_eigen(a, k):
    values, vectors = whitening.eigen(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    scale = max(np.abs(a).max(initial=0), 1e-300)
    assert np.allclose(values, want, rtol=0, atol=1e-13 * scale * len(a))
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max(initial=0) < 1e-12
    assert np.abs(vectors @ a - values[:, None] * vectors).max(initial=0) < 1e-12 * scale * len(a)


def test_eigen_of_plain_clustered_and_degenerate_matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 65, 200):
        x = rng.standard_normal((n, n))
        check_eigen(x @ x.T, 8)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for d in ([5.0] * 12 + [1.0] * 28, [5.0 + 1e-13 * i for i in range(12)] + [0.0] * 28, [1.0] * 40, [0.0] * 40, [1e150] * 3 + [1.0] * 37, [10.0**-i for i in range(40)]):
        check_eigen((q * np.array(d)) @ q.T / 2 + ((q * np.array(d)) @ q.T).T / 2, 8)
    check_eigen(np.diag([3.0, 3.0, 1.0, 1.0, 0.0]), 8)


def plain_whitening(vectors, k=8):
    """n, deviations, absolute whitened values and shares of the trace by numpy's own solver."""
    x = np.floor(1024.0 * np.array(vectors, np.float64)) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, q = np.linalg.eigh(y.T @ y / n)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, np.abs(y @ q / np.sqrt(values)), values / np.trace(y.T @ y / n)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((700, 20)) * np.linspace(1, 3, 20) + 5).astype(np.float32)
    odd = [(900, None), (901, [1.0, None] * 10), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (None, v[0].tolist()), (5, v[5].tolist()), (950, [])]
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + odd
    df = spark.createDataFrame([(i, r, 1, 2.0, "x") for i, r in rows], "vec_id long, embedding array<float>, dim int, n double, w string")
    got, models = whitening.whiten(df.repartition(5))
    used = [*v, v[0], v[5]]
    n, deviation, w, explained = plain_whitening(used)
    want = {i: (d, r) for i, d, r in zip([*range(700), None, 5], deviation, w, strict=True)}
    out = got.collect()
    assert len(out) == 702 and {r["n"] for r in out} == {n}
    for r in out:
        assert r["deviation"] == want[r["vec_id"]][0] and np.allclose(np.abs(r["w"]), want[r["vec_id"]][1], atol=1e-9)
    (m,) = models.collect()
    assert m["error"] < 1e-9 and np.allclose(np.array(m["values"]) / m["trace"], explained, rtol=1e-10)


def test_whitening_of_few_equal_and_mixed_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    empty, models = whitening.whiten(spark.createDataFrame([], schema))
    assert empty.collect() == models.collect() == []
    (one,) = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0])], schema))[0].collect()
    assert (one["n"], one["deviation"], one["w"]) == (1, 0, [None, None])
    # two lengths; one varies along a line only
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    rows, models = whitening.whiten(spark.createDataFrame(line + [(100, [1.0]), (101, [3.0])], schema))
    out = {r["vec_id"]: r for r in rows.collect()}
    assert {r["n"] for i, r in out.items() if i < 100} == {10} and out[100]["n"] == 2
    assert [abs(round(out[i]["w"][0], 9)) for i in (100, 101)] == [1, 1] and all(out[i]["w"][1:] == [None, None] for i in range(10))
    assert math.isclose(sum(r["w"][0] ** 2 for i, r in out.items() if i < 100), 10, rel_tol=1e-9)
    assert all(m["error"] < 1e-9 for m in models.collect())
    # squares beyond a long, sums beyond 53 bits
    big = [(i, [float(i) * 1e12, 1.0]) for i in range(4)]
    out = whitening.whiten(spark.createDataFrame(big, schema))[0].collect()
    assert all(r["deviation"] is None and abs(r["w"][0]) < 2 for r in out)


def plain_dedup(rows, k):
    find = re.compile("[^\x20\x09-\x0d]+").findall
    least = {}
    for doc, text in rows:
        w = find(text or "")
        for i in range(len(w) - k + 1):
            if doc is not None:
                least[tuple(w[i : i + k])] = min(doc, least.get(tuple(w[i : i + k]), doc))
    out = Counter()
    for doc, text in rows:
        w = find(text or "")
        gone = set()
        for i in range(len(w) - k + 1):
            if doc is not None and least[tuple(w[i : i + k])] < doc:
                gone |= set(range(i, i + k))
        out[doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def deduped(df, **kw):
    out = repeats.dedup(df, **kw).collect()
    assert all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] for r in out)
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out)


def test_repeats(spark, docs, empty):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    both = docs.select("doc_id", "text").unionByName(small)
    assert deduped(both.repartition(3)) == plain_dedup([tuple(r) for r in both.collect()], 13)
    assert deduped(docs) == plain_dedup([tuple(r) for r in docs.select("doc_id", "text").collect()], 13)
    assert deduped(empty) == Counter()


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_repeats_of_few_words_and_hot_minimisers(spark, monkeypatch, hot):
    """Chains of overlaps, periods, passages in many documents with other surroundings, and very frequent minimisers."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(int(rng.integers(0, 60)), " ".join(rng.choice(["a", "b"], int(rng.integers(0, 90))))) for _ in range(80)]
    rows += [(i, f"x{i} y{i}  {passage}\n z{i} {passage} u{i}") for i in range(100, 160)]
    rows += [(200, "a " * 500), (201, "a " * 12), (202, "a " * 13), (203, "a b " * 300), (199, "b " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert deduped(df.repartition(4), k=7, m=3) == plain_dedup(rows, 7)
    assert deduped(df.repartition(4)) == plain_dedup(rows, 13)
