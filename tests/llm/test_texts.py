"""Text operators against brute force, on the awkward rows and on a tenth of the smallest supplied table."""

import hashlib
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.llm import bpe, decontaminate, jaccard, langid, pii, sharding
from wavefold.llm.queries import held_out, tokenizer_path

LOWER = {i: i + 32 for i in range(65, 91)}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_components(texts, k, num, den):
    """Per (position, id, text): size of the set, least id reachable."""
    sets = []
    for _, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if texts[i][0] is not None and texts[j][0] is not None and sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), None if d is None else least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(texts))


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, docs, sf_docs, k, num):
    all_ = docs.select("doc_id", "text").unionByName(sf_docs.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    got = Counter(tuple(r)[:3] for r in jaccard.join(all_, k=k, num=num, den=100).collect())
    assert got == brute_components([tuple(r) for r in all_.collect()], k, num, 100)


def test_jaccard_chains_and_groups_larger_than_a_block(spark):
    """A chain whose ends don't link, many near copies (more than a group holds) and near misses."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[: 120 - i])) for i in range(30)]
    rows += [(1000 + i, " ".join([*(f"v{j}" for j in range(100)), f"own{i}"])) for i in range(600)]
    rows += [(5000 + i, " ".join(f"v{j}" if j % 17 != i else f"z{i}" for j in range(100))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r)[:3] for r in jaccard.join(df, k=4, num=85, den=100).collect())
    assert got == brute_components(rows, 4, 85, 100)


def test_jaccard_of_a_hot_cluster_that_shares_tokens_with_others(spark):
    """Very many near copies, a few others that link with some of them only, and others that share much without a link."""
    base = [f"v{j}" for j in range(60)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(3000)]
    rows += [(4000 + i, " ".join([*base, f"own{i}", *(f"p{i} {j}" for j in range(2 + i))])) for i in range(12)]
    rows += [(5000 + i, " ".join([*base[: 30 + i], *(f"q{j}" for j in range(30 - i))])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r)[:3] for r in jaccard.join(df, k=4, num=85, den=100).collect())
    # a tenth of the copies says as much by brute force
    few = [(i, t) for i, t in rows if i < 300 or i >= 4000]
    want = brute_components(few, 4, 85, 100)
    assert Counter({k: n for k, n in got.items() if k[0] < 300 or k[0] >= 4000}) == want
    assert all(k[2] == 0 for k in got if k[0] < 3000)


def test_jaccard_empty(empty):
    assert jaccard.join(empty).collect() == []


def test_decontaminate(spark, docs, sf_docs):
    items = [(1, "ten eleven"), (2, None), (3, ""), (4, "alpha BETA, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (5, "wort " * 12), (10, "Theta iota kappa lambda mu nu xi omicron pi rho sigma")]
    bench = spark.createDataFrame(items, "item_id long, text string").unionByName(spark.read.parquet(f"{SF}/benchmark.parquet"))
    all_ = docs.select("doc_id", "text").unionByName(sf_docs.select("doc_id", "text"))
    got = Counter((r[0], r[1], r[2], tuple(r[3])) for r in decontaminate.decontaminate(all_, bench).collect())
    assert got == brute_hits(all_, bench)


def brute_hits(docs, bench):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    wins = defaultdict(set)
    for i, t in bench.collect():
        w = find((t or "").translate(LOWER))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[j : j + n])].add(str(i))
    want = Counter()
    for d, t in docs.collect():
        w = find((t or "").translate(LOWER))
        hit, its = set(), set()
        for n in {len(x) for x in wins}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in wins:
                    hit.update(range(j, j + n))
                    its |= wins[x]
        want[(d, len(w), len(hit), tuple(sorted(its)))] += 1
    return want


def test_decontaminate_repetitive_passages(spark):
    """Equal words, short periods and a passage that comes again and again, on both sides; nothing is squared."""
    parts = ["wort ", "a b ", "a b c d e f g ", "one two three four five six seven eight nine ten eleven "]
    texts = [p * (20_000 // len(p.split())) for p in parts] + ["x " + p * 30 + "y" for p in parts] + ["a b c " * 3, "".join(f"{p}{i} " for i in range(300) for p in parts[3:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, p * (2_000 // len(p.split()))) for i, p in enumerate(parts)] + [(9, "wort wort"), (10, "eleven " + parts[3])], "item_id long, text string")
    begin = time.monotonic()
    got = decontaminate.decontaminate(docs, bench).collect()
    assert time.monotonic() - begin < 30
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == brute_hits(docs, bench)
    by_id = {r["doc_id"]: r["spans"] for r in got}
    assert [tuple(s) for s in by_id[0]] == [(0, 20_000)] and len(by_id[9]) == 600  # two windows a passage


def test_decontaminate_item_without_id(spark, docs):
    """Its words hit as any item's do; only the names leave it out."""
    bench = spark.createDataFrame([(None, "alpha BETA, gamma delta epsilon zeta eta theta iota kappa lambda"), (7, "pi rho sigma tau upsilon phi chi psi omega one two"), (None, "two words")], "item_id long, text string")
    got = Counter((r["doc_id"], r["n_hit"], tuple(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect() if r["n_hit"])
    assert got == Counter({(1, 22, ("7",)): 1, (2, 22, ("7",)): 1, (3, 22, ("7",)): 2, (None, 22, ("7",)): 1, (8, 2, ()): 1})


def test_decontaminate_empty(spark, empty, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty, none).collect() == []
    assert {r["n_hit"] for r in decontaminate.decontaminate(docs, none).collect()} == {0}


def test_bpe_is_as_the_library_has_it(docs, sf_docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path()
    lib = tokenizers.Tokenizer.from_file(path)
    all_ = docs.select("doc_id", "text").unionByName(sf_docs.select("doc_id", "text"))
    want = Counter()
    for d, t in all_.collect():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        out = lib.decode(ids, skip_special_tokens=False)
        want[(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(all_, path).collect())) == want
    back = bpe.decode(bpe.encode(docs, path), path)
    assert Counter((r["doc_id"], len(r["ids"]), hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in back.collect()) == Counter(x for x in map(tuple, bpe.round_trip(docs, path).collect()))


def test_bpe_on_many_characters_and_long_words():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path()
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.codec(path)
    texts = ["".join(chr(i) + ("a" if i % 3 else " ") for i in range(a, a + 4096) if unicodedata.category(chr(i)) not in ("Cn", "Cs")) for a in range(0, 0x20000, 4096)]
    for t in [*texts, "ab" * 5000, "a" * 101, "<|endoftext|><|startoftext|>x<|endoftext", "İΣ Σ'S"]:
        assert lib.encode(t, add_special_tokens=False).ids == np.frombuffer(own.encode(t), "<u4").tolist()


def test_bpe_empty(empty):
    assert bpe.round_trip(empty, tokenizer_path()).collect() == []


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs, ~held_out(F.col("doc_id")))
    out = langid.identify(docs, model).filter(held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert sum(r["rejected"] for r in out) <= 0.02 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)
    junk = spark.createDataFrame([("qxzj wvkq zzxq jjqw xkcd pqzx vwkj qqzj " * 20,), ("Thing",), (None,), ("12 34 !",)], "text string")
    got = langid.identify(junk, model).collect()
    assert got[0]["rejected"] and got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[2]["rejected"]


def test_language_probabilities_add_up(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs, F.lit(True))
    letters = "abcdefghijklmnopqrstuvwxyz éèêçñíóäöüßà"
    for context in ("   ", "the", "qzx"):
        total = sum(np.exp(model.logs(np.frombuffer((context + c).encode("utf-32-le"), "<u4"))[0]) for c in letters)
        assert (total <= 1.0001).all() and (total > 0.5).all()


def test_language_awkward_rows(docs, empty):
    model = langid.learn(docs, F.lit(True))
    out = langid.identify(docs, model).collect()
    assert len(out) == docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in out if not re.search("[a-zA-ZΑ-Ω]", r["text"] or ""))
    assert langid.learn(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_language_keeps_each_labelled_language(spark, docs):
    """A language with one text, whatever its hash or size, is learnt; and what has no letters is not learnt from."""
    words = {"pl": "zażółć gęślą jaźń chrząszcz brzmi w trzcinie", "hu": "árvíztűrő tükörfúrógép öt szép szűzlány őrült írót nyúz", "en": "the quick brown fox jumps over the lazy dog again and again"}
    for seed in range(12):
        rows = [(seed * 100 + i, (words["en"] + f" {i} ") * 20, "en") for i in range(60)]
        rows += [(seed * 100 + 70, words["pl"] * 5, "pl"), (seed * 100 + 71, words["hu"] * 3000, "hu"), (seed * 100 + 72, "12 34", "xx"), (seed * 100 + 73, None, "yy")]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = langid.learn(df, F.lit(True), max_bytes=20_000)
        assert model.langs == ["en", "hu", "pl"]
    out = {r["doc_id"] % 100: (r["lang_pred"], r["rejected"]) for r in langid.identify(df, model).collect()}
    assert out[70] == ("pl", False) and out[71] == ("hu", False) and out[72] == out[73] == ("und", True)
    few = langid.learn(df, F.lit(True), most_bytes=3_000)
    assert few.langs == ["en", "hu", "pl"]
    # columns of docs that are called as those in between
    assert langid.learn(df.withColumn("place", F.lit(1)).withColumn("least", F.lit("x")).withColumn("share", F.lit(None)), F.lit(True)).langs == ["en", "hu", "pl"]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_spans(spark, docs, sf_docs):
    odd = ["a@b.c_d@e.f.", "x@a.b.@c.d", "..@a.b @c.d a@b a@b.-", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.2.3", "4111-1111 1111-1111 4111111111111111 4111111111111112", "++1 222 333 4444) +1", "GB82 WEST 1234 5698 7654 32 GB82 WEST 1234 5698 7654 33", "é😀 a@b.cé", "1 " * 4000, "a." * 4000 + "@b.c"]
    all_ = docs.select("text").unionByName(sf_docs.select("text")).unionByName(spark.createDataFrame([(x,) for x in odd], "text string"))
    for r in pii.find(all_).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in BASE] == brute_pii(r["text"]), r["text"][:80]
    [iban] = [r["pii"] for r in pii.find(spark.createDataFrame([("iban GB82 WEST 1234 5698 7654 32, XX82 WEST 1234 5698 7654 33",)], "text string")).collect()]
    assert [(s["kind"], s["start"], s["end"], s["score"]) for s in iban if s["kind"] == "iban"] == [("iban", 5, 32, 1.0)]


def test_pii_many_matches_take_time_in_proportion(spark):
    """Very many matches that fail, and very many that hold, in one text; masked as well."""
    texts = ["12345," * 35_000, "12345," * 350_000, "call é +1 222 333 4444; mail a@b.cd, and " * 5_000, "x" * 3000 + "card 4111 1111 1111 1111 " * 700]
    found = pii.find(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, m_card int"))
    begin = time.monotonic()
    rows = {r["m_card"]: r for r in found.collect()}
    assert time.monotonic() - begin < 60
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in rows[i]["pii"] if s["kind"] in BASE] == brute_pii(t)
    masked = {r["m_card"]: r["text"] for r in pii.redact(found).collect()}
    assert masked[1] == texts[1] and masked[2] == "call é [PHONE]; mail [EMAIL], and " * 5_000
    assert masked[3] == "x" * 3000 + "card [CARD] " * 700


def test_pii_context_reaches_over_any_matches_that_are_near(spark):
    """A word within NEAR code points counts, before and behind, however many short matches lie between."""
    before = [(n, "card," + "11," * n + "4111111111111111") for n in range(20)]
    behind = [(100 + n, "4111111111111111" + ",11" * n + ",card") for n in range(20)]
    df = spark.createDataFrame(before + behind, "doc_id long, text string")
    got = {r["doc_id"]: next(s["score"] for s in r["pii"] if s["end"] - s["start"] == 16) for r in pii.find(df).collect()}
    near = {i: "card" in t[: -16][-pii.NEAR :] for i, t in before} | {i: "card" in t[16:][: pii.NEAR] for i, t in behind}
    assert {i: abs(x - 0.9) < 1e-9 for i, x in got.items()} == near
    assert near[10] and near[110] and not near[19] and not near[119]


def test_pii_redaction_merges_overlaps(spark):
    """Spans of several kinds over blocks' bounds, against a plain version."""
    texts = ["é" * (i * 7) + " +1 222.1.1.1 4111 1111 1111 1111 a1.2.3.4@x.yz " * (i * 9) for i in range(1, 9)]
    rows = pii.find(spark.createDataFrame([(t,) for t in texts], "text string")).withColumn("old", F.col("text"))
    for r in pii.redact(rows).collect():
        out, to = [], 0
        for kind, a, b in sorted(((s["kind"], s["start"], s["end"]) for s in r["pii"]), key=lambda s: (s[1], s[2], s[0].upper())):
            if a >= to:
                out.append(r["old"][to:a] + f"[{kind.upper()}]")
            to = max(to, b)
        assert r["text"] == "".join(out) + r["old"][to:]


def test_pii_redaction(spark, empty):
    rows = [("a@b.c, é +1 222 333 4444 end",), (None,), ("nothing",), ("4111 1111 1111 1111",)]
    got = [r["text"] for r in pii.redact(pii.find(spark.createDataFrame(rows, "text string"))).collect()]
    assert got == ["[EMAIL], é [PHONE] end", None, "nothing", "[CARD]"]
    assert pii.find(empty).collect() == []


def test_shards(spark, docs, sf_docs, empty):
    all_ = sf_docs.select("doc_id", "text", "lang", "source")
    out = sharding.shard(all_, shards=8).collect()
    assert len(out) == all_.count()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    odd = sharding.shard(docs, target_bytes=100_000).collect()
    assert len(odd) == docs.count() and {r["size"] for r in odd if r["doc_id"] == 4} == {16}
    assert sharding.shard(empty, shards=4).collect() == []
    same = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "'s' AS source")
    n = Counter(r["shard"] for r in sharding.shard(same, shards=5).collect())
    assert max(n.values()) - min(n.values()) <= 2


def test_shards_sizes_and_slots_by_brute_force(spark, docs, sf_docs):
    """Sizes, checksums and the numbering of slots, on awkward rows, ids and texts that repeat, and clashing names."""
    for all_ in (docs, sf_docs):
        rows = all_.select("doc_id", "text").collect()
        out = sharding.shard(all_, shards=7).collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
        for shard in {r["shard"] for r in out}:
            assert 0 <= shard < 7 and sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))


def brute_split(rows, leaves, first=0):
    """{row number: shard} for rows (number, size, keys): the k-d tree by its definition."""
    if leaves == 1 or not rows:
        return {n: first for n, _, _ in rows}
    width = [max(k[i] for _, _, k in rows) - min(k[i] for _, _, k in rows) for i in range(len(rows[0][2]))]
    dim = width.index(max(width))
    goal, before, cut = sum(s for _, s, _ in rows) * (leaves // 2) / leaves, 0, 0
    by = defaultdict(int)
    for _, s, k in rows:
        by[k[dim]] += s
    for key in sorted(by):
        if before <= goal:
            cut = key
        before += by[key]
    low, high = [r for r in rows if r[2][dim] < cut], [r for r in rows if r[2][dim] >= cut]
    return brute_split(low, leaves // 2, first) | brute_split(high, leaves - leaves // 2, first + leaves // 2)


@pytest.mark.parametrize(("n", "shards"), [(500, 11), (2000, 10_000)])
def test_shards_are_those_of_a_k_d_tree(spark, n, shards):
    """Few and very many shards, ties in every dimension, rows without size."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 900)) * (i % 7 > 0), [int(rng.integers(0, 1 << 60)), int(rng.integers(0, 40)) << 50, int(rng.integers(0, 3)) << 58 | i]) for i in range(n)]
    df = spark.createDataFrame([(i, s, *k) for i, s, k in rows], "n long, size long, a long, b long, c long")
    got = {r["n"]: r["shard"] for r in sharding.split(df, ["a", "b", "c"], "size", shards).collect()}
    assert got == brute_split(rows, shards)
