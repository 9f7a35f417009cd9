"""The registered queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, jaccard, langid, merkle, pii, repeats, sharding, topk, url_rules, warc, whitening, wrappers
from .common import scratch

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id mod 4 is 2; also without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


#: Rules for op1: verdict, host and path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), to)
    return warc.read(spark, to, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, ~held_out(F.col("doc_id")))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    n = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = ["email", "ip", "card", "phone"]
    return found.select("doc_id", *map(n, base), F.sha2(line(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda n_chars: merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(F.col("n_chars") + 1))
    whole = merkle.build(docs, leaf(F.col("n_chars")), F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "tampered": tampered})
    found = merkle.prove(whole)
    hexed = lambda c: F.lower(F.hex(c))
    folded = merkle.folded(F.coalesce("own.tampered", "own.leaf"), F.col("path"), F.col("idx"), F.col("n"), F.col("tree"), F.col("groups"))
    out = found.select("own.doc_id", hexed("own.leaf").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(whole.root).cast("string").alias("root"), F.sha2(hexed("path").cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, models = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)
    rows = rows.select("vec_id", "dim", "n", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.when(F.col("trace") > 0, F.element_at("values", F.col("at") + 1) / F.col("trace")).otherwise(0.0)
    return rows.join(models.select("dim", "values", "trace", F.col("error").alias("identity_error")), "dim").select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), "identity_error")


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"), k=13).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_rules, op2_warc, op3_decontaminate, op4_bpe, op5_language, op6_main_text, op7_topk, op8_shards, op9_pii, op10_jaccard, op11_manifest, op12_whiten, op13_repeats)}

ORACLES: dict[str, str] = {}

ORACLES["op3_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) t WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) t),
hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLES["op7_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_WORDS10 = r"string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '[\x20\x09-\x0D]+')"


def _jaccard_sql(k: int, num: int, den: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, CASE WHEN x = [''] THEN [] ELSE x END AS w FROM (SELECT doc_id, {_WORDS10} AS x FROM documents)),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({k}, len(w)) - 1], ' ') AS g
      FROM w, LATERAL (SELECT unnest(range(1, len(w) - least({k}, len(w)) + 2)) AS i) t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * o >= {num} * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""


ORACLES["op10_jaccard"] = _jaccard_sql(4, 85, 100)

_B32 = "||".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {15 - 5 * j}) & 31)]" for i in range(8) for j in range(4))
ORACLES["op2_warc"] = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h AS kh, max(page_id) AS keep FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN k ON h = kh
"""

_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(substr(reverse({d}), i, 1) AS INTEGER) > 4 THEN CAST(substr(reverse({d}), i, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr(reverse({d}), i, 1) AS INTEGER) * 2 END ELSE CAST(substr(reverse({d}), i, 1) AS INTEGER) END)) % 10 = 0"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
#: Kinds with their plain patterns and tests; \b stands for the look-around of the iban pattern, which SQL here lacks.
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(nullif(right(p, 3), '') AS INTEGER), 0) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND " + _LUHN.format(d=_DIGITS)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(m, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda s, v: (s * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"),
}


def _pii_sql() -> str:
    parts = []
    for n, (kind, (pattern, test)) in enumerate(_PII.items()):
        parts.append(f"""SELECT doc_id, {n} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, m[i] AS m, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) u) WHERE {test}""")
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in list(_PII)[:4])
    line = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}),
a AS (SELECT doc_id, {counts}, string_agg({line}, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg({line}, ',' ORDER BY k, s) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in list(_PII)[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


ORACLES["op9_pii"] = _pii_sql()

def _manifest_sql() -> str:
    # crc32 bit by bit, since SQL here has none
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, 8 * length(s)), lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(s, 1 + i // 8, 1)) AS BIGINT) ELSE CAST(0 AS BIGINT) END)), lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(map(part, ["doc_id", "source", "lang", n, "text"])) + ")"
    # levels of a forest (g, i, h) with t nodes a tree; of its leaves, the siblings (sib, by level) and the folded value
    up = lambda src: f"SELECT g, l + 1 AS l, i // 2 AS i, (t + 1) // 2 AS t, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {src} WHERE t > 1 GROUP BY g, l, i // 2, t"
    fold = lambda: "sha256(CASE WHEN s.h IS NULL THEN p.f WHEN (p.i >> p.l) % 2 = 1 THEN s.h || p.f ELSE p.f || s.h END)"
    return f"""
WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents),
a AS (SELECT doc_id, coalesce(lang, chr(1)) AS g, {leaf('n_chars')} AS leaf, {leaf('(n_chars + 1)')} AS bad, {crc} AS c FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS t FROM a),
n AS (SELECT g, 0 AS l, i, t, leaf AS h FROM b UNION ALL {up('n')}),
q AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS t FROM n WHERE t = 1),
m AS (SELECT 0 AS g, 0 AS l, i, t, h FROM q UNION ALL {up('m')}),
p AS (SELECT doc_id, g, i, 0 AS l, t, CASE WHEN c % 7 = 0 THEN bad ELSE leaf END AS f, '' AS path FROM b
      UNION ALL SELECT p.doc_id, p.g, p.i, p.l + 1, (p.t + 1) // 2, {fold()}, p.path || coalesce(s.h, '')
      FROM p LEFT JOIN n s ON s.g = p.g AND s.l = p.l AND s.i = xor(p.i >> p.l, 1) WHERE p.t > 1),
r AS (SELECT p.doc_id, q.i, 0 AS l, q.t, p.f, p.path, q.h AS subroot FROM p JOIN q ON q.g = p.g WHERE p.t = 1
      UNION ALL SELECT p.doc_id, p.i, p.l + 1, (p.t + 1) // 2, {fold()}, p.path || coalesce(s.h, ''), p.subroot
      FROM r p LEFT JOIN m s ON s.l = p.l AND s.i = xor(p.i >> p.l, 1) WHERE p.t > 1),
o AS (SELECT h AS root FROM m WHERE t = 1)
SELECT r.doc_id, b.leaf, r.subroot, o.root, sha256(r.path) AS proof_sha256, r.f AS folded_root, r.f = o.root AS verified
FROM r JOIN b ON b.doc_id = r.doc_id, o WHERE r.t = 1
"""


ORACLES["op11_manifest"] = _manifest_sql()

_WORDS13 = r"string_split_regex(trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '[\x20\x09-\x0D]+')"
ORACLES["op13_repeats"] = f"""
WITH w AS (SELECT doc_id, CASE WHEN x = [''] THEN [] ELSE x END AS w FROM (SELECT doc_id, {_WORDS13} AS x FROM documents)),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) t),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, i + j AS i FROM g JOIN f USING (g), LATERAL (SELECT unnest(range(0, 13)) AS j) t WHERE least < doc_id),
p AS (SELECT doc_id, i, w[i] AS x FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) t),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM p ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
