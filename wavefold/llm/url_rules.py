"""URL filters by association rules.

FP-growth (Spark's own, on the executors) mines combinations of URL tokens with the label; rules of enough support and
confidence that beat every shorter rule inside them are kept. Of tokens that occur on the same labelled pages, as a host
and its suffixes may, the longest stands for all, since their combinations say the same and double with each of them.
The rules are matched by an inverted index from token to rule: a rule fits a URL that has all its tokens. Given rules for
hosts and paths go first; the longest that fits decides.

Edge cases: a null URL or one without ``://`` has an empty host and path and no tokens; unlabelled pages are judged
too; without labels there are no learnt rules and all is allowed; a page with several labels is learnt from once for
each; URLs are read whole however long, and of a host with many labels the tokens are its last LABELS suffixes and the
whole; each row gives one row.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise

BLOCK_ITEM = "label=block"
#: Suffixes of a host that are tokens have at most so many labels, but for the whole host.
LABELS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: suffixes of the host, the path's segments (numbers as #), the query's keys."""
    suffixes = F.array(*(F.concat(F.lit("h:"), x) for x in [*(F.substring_index(host, ".", -i) for i in range(1, LABELS + 1)), host]))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "#")))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1)))
    return F.when(host != "", F.array_sort(F.array_distinct(F.concat(suffixes, segments, keys)))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, *, min_support: float = 0.01, min_confidence: float = 0.6) -> DataFrame | None:
    """Rules (rule, antecedent, confidence, support) for blocking, from rows (tokens, blocked); None without rows."""
    labelled = materialise(labelled, "labelled")
    n = labelled.count()
    if not n:
        return None
    # no more tokens are frequent than a page has on average, divided by the support
    marks = [F.sum(F.xxhash64("tokens", F.lit(seed)).cast("decimal(20,0)")).alias(f"mark{seed}") for seed in (1, 2)]
    frequent = labelled.select("tokens", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *marks).filter(F.col("n") >= min_support * n)
    stand = frequent.groupBy("n", "mark1", "mark2").agg(F.max_by("token", F.struct(F.length("token"), "token")).alias("token"))
    kept = F.array_intersect("tokens", stand.agg(F.collect_list("token")).scalar())
    items = materialise(labelled.select("blocked", kept.alias("tokens")), "items")
    items = items.select(F.when(F.col("blocked"), F.array_append("tokens", BLOCK_ITEM)).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK_ITEM) & (F.col("lift") > 1))
    rules = materialise(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "rules")
    # a rule goes if one with a token less is as good
    shorter = rules.select("antecedent", "confidence", F.explode("antecedent").alias("left_out")).select("antecedent", "confidence", F.array_remove("antecedent", F.col("left_out")).alias("inner"))
    best = rules.select(F.col("antecedent").alias("inner"), F.col("confidence").alias("inner_confidence"))
    beaten = shorter.join(best, "inner").filter("inner_confidence >= confidence").select("antecedent").distinct()
    kept = rules.join(beaten, "antecedent", "left_anti")
    return materialise(kept.withColumn("rule", F.array_join("antecedent", " ")), "kept")


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets of ``pages`` that some rule fits: (tokens, learnt_rule), the most confident."""
    index = materialise(rules.select("rule", "confidence", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token")), "index")
    sets = materialise(pages.select("tokens").distinct(), "token_sets")
    hits = sets.withColumn("token", F.explode("tokens")).join(index, "token")
    full = hits.groupBy("tokens", "rule", "confidence", "n").agg(F.count("*").alias("found")).filter("found = n")
    return full.groupBy("tokens").agg(F.max_by("rule", F.struct("confidence", "rule")).alias("learnt_rule"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], *, min_support: float = 0.01, min_confidence: float = 0.6) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule, verdict, learnt_rule. ``labels`` has doc_id,
    quality and toxic: toxic or low quality is to be blocked. ``rules`` are (verdict, host/path)."""
    host, path = host_and_path(F.col("url"))
    slim = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    slim = slim.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    known = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).select(F.col("doc_id").alias("page_id"), (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("blocked"))
    mined = mine(slim.select("page_id", "tokens").join(known, "page_id").select("tokens", "blocked"), min_support=min_support, min_confidence=min_confidence)
    if mined is None:
        out = slim.withColumn("learnt_rule", F.lit(None).cast("string"))
    else:
        out = slim.join(materialise(match(slim, mined), "matched"), "tokens", "left")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("learnt_rule").isNotNull(), "block").otherwise("allow")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "learnt_rule")
