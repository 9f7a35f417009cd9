"""The pipeline's stages on awkward rows, each against a plain version of its decision."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_texts import brute_components, brute_pii
from wavefold.llm import bpe
from wavefold.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    docs.select(*COLUMNS).unionByName(small.select(*COLUMNS)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def after(spark, sf_dir, tmp_path_factory):
    """What each stage leaves."""
    out, df = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    out[""] = df.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, df, sf_dir).write.parquet(path)
        df = spark.read.parquet(path)
        out[name] = df.collect()
    return out


def test_columns_are_kept(after):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(after[name][0].asDict()) == COLUMNS


def test_language_keeps_what_has_language(after):
    left = Counter((r["doc_id"], r["text"]) for r in after["language"])
    assert all(t is not None and re.search("[^\\W\\d_]", t) for _, t in left)
    gone = Counter((r["doc_id"], r["text"]) for r in after[""]) - left
    assert sum(1 for i, t in gone if i and i >= 100 and t) <= 6


def test_one_of_each_group_stays(after):
    rows = [(r["doc_id"], r["text"]) for r in after["language"]]
    # by brute force: rows whose component is their own id, once for each id and text
    want = set()
    for (doc, text), comp in zip(rows, per_row(rows), strict=True):
        if doc is None or doc == comp:
            want.add((doc, text))
    got = [(r["doc_id"], r["text"]) for r in after["near_duplicates"]]
    assert set(got) == want and len(got) == len(set(got))


def per_row(rows):
    found = {}
    sets = brute_components(rows, 5, 80, 100)
    by_id = {}
    for (doc, _, comp), _n in sets.items():
        by_id.setdefault(doc, []).append(comp)
    for doc, text in rows:
        comps = by_id[doc]
        found[doc, text] = comps[0] if len(set(comps)) == 1 else doc
    return [found[r] for r in rows]


def test_benchmark_passages_go(spark, sf_dir, after):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    wins = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = find(r["text"].lower())
        wins |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = lambda t: not any(tuple(w[i : i + 10]) in wins for w in [find(t.lower())] for i in range(len(w) - 9))
    want = Counter((r["doc_id"], r["text"]) for r in after["near_duplicates"] if clean(r["text"]))
    assert Counter((r["doc_id"], r["text"]) for r in after["decontaminate"]) == want


def test_personal_data_is_masked(after):
    before = {(r["doc_id"], r["source"], r["lang"]): r for r in after["decontaminate"]}
    assert len(after["personal_data"]) == len(after["decontaminate"])
    for r in after["personal_data"]:
        assert brute_pii(r["text"]) == [] or "[" in r["text"]
        old = before.get((r["doc_id"], r["source"], r["lang"]))
        if old and not brute_pii(old["text"]):
            assert (r["text"], r["n_chars"]) == (old["text"], old["n_chars"])
        elif old:
            assert r["n_chars"] == len(r["text"])


def test_tokens_decode(after):
    enc = bpe.codec(tokenizer_path())
    texts = Counter(enc.encode(r["text"]) for r in after["personal_data"])
    assert Counter(np.array(r["ids"], "<u4").tobytes() for r in after["tokens"]) == texts
    assert all(r["n_tokens"] == len(r["ids"]) for r in after["tokens"])


def test_empty_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf_dir)
        assert df.collect() == []


def test_rows_and_not_ids_are_dropped(spark, tmp_path):
    """Null ids, and ids that are repeated with other texts."""
    words = [f"w{i}" for i in range(40)]
    text, near, other = " ".join(words), " ".join([*words, "more"]), " ".join(f"v{i}" for i in range(40))
    alone = " ".join(f"u{i}" for i in range(40))
    rows = [(1, text), (1, near), (1, other), (2, near), (None, alone), (None, alone), (None, alone + " more"), (None, "a b c"), (3, " "), (4, " "), (None, None), (5, None), (6, ""), (6, "")]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    firsts = lambda *some: [t for t in some if got[t]]
    assert len(firsts((1, text), (1, near))) == 1 and len(firsts((None, alone), (None, alone + " more"))) == 1
    assert got[(1, other)] == 1 and got[(None, "a b c")] == 1 and (2, near) not in got
    assert got[(3, " ")] == got[(4, " ")] == got[(None, None)] == got[(5, None)] == got[(6, "")] == 1
    assert sum(got.values()) == 9

    bench = " ".join(words[3:15])
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate(spark, df.unionByName(df.filter("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))), f"file://{tmp_path}").collect())
    hit = {text, near}
    assert got == Counter((i, t) for i, t in [*rows, (None, other)] if t not in hit)


def test_other_columns_stay_as_they_are(spark, docs, sf_dir):
    """Every name that a stage uses inside, an odd name, a map and a struct; the values go with their rows."""
    names = ["text_hash", "nth", "pii", "rejected", "score", "entropy", "lang_pred", "place", "grp", "n", "best", "component", "component_id", "n_shingles", "n_hit", "items", "spans", "ids", "own", "rid", "other_columns", "_text", "__text", "odd `name`.x"]
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mine = base.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names})
    mine = mine.withColumn("some map", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("some struct", F.struct("doc_id", F.col("text").alias("pii")))
    plain = base
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, mine = (stage(spark, df, sf_dir) for df in (plain, mine))
        assert mine.columns == [*base.columns, *names, "some map", "some struct"]
        rows = mine.collect()
        assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows) == Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in plain.collect()), name
        for r in rows:
            at = "-" if r["doc_id"] is None else str(r["doc_id"])
            assert all(r[c] == f"{c}:{at}" for c in names) and r["some map"] == {"k": r["doc_id"]} and r["some struct"]["doc_id"] == r["doc_id"]
        plain, mine = spark.createDataFrame(plain.collect(), plain.schema), spark.createDataFrame(rows, mine.schema)
    assert set(corpus_pipeline.tokens(spark, mine, sf_dir).columns) == {"doc_id", "lang", "source", "n_tokens", "ids"}
