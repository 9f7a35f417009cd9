"""The corpus pipeline: documents in, token ids out, in five stages of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the
next stage's docs. All but the last keep the columns of documents.

Columns beside those of documents, whatever they are called, travel in one struct, so that no stage meets or overwrites
them; all but the last stage return them as they came. Very long texts are read whole; of rows that tie in all columns of
documents the first by the other columns, as JSON, stays.

Rows are told apart by id and text, a null id being one id, so that a hit or a group drops the rows it is about and no
others of their id. Rows without id are no copies of rows that have one; of each group of them one stays. Null texts are rejected with the texts without letters; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from wavefold.llm import bpe, decontaminate as winnow, jaccard, langid, pii
from wavefold.llm.common import materialise, scratch
from wavefold.llm.queries import held_out, table, tokenizer_path


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What holds the other columns while a stage works.
OTHERS = "other_columns"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """``stage`` on the columns of documents, beside a struct of all others."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        quoted = lambda c: "`" + c.replace("`", "``") + "`"
        packed = docs.select(*(c for c in docs.columns if c in COLUMNS), F.struct(*map(quoted, others)).alias(OTHERS))
        out = stage(spark, packed, sf_dir)
        if OTHERS not in out.columns:
            return out
        return out.select(*(F.col(OTHERS)[c].alias(c) if c in others else F.col(c) for c in docs.columns))

    return run


@apart
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject."""
    model = langid.learn(docs, ~held_out(F.col("doc_id")))
    return langid.identify(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one id and one text; a null id is one id."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of the least id, and of
    rows of one id that of the least text hash."""
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    # texts, not ids, are what is linked: component_id is the least hash of a group, whatever ids its rows have
    found = jaccard.join(keyed.select("text_hash", "text"), k=5, num=80, den=100, id_col="text_hash")
    groups = found.groupBy("text_hash").agg(F.first("component_id").alias("component"), F.max("n_shingles").alias("n"))
    pairs = keyed.select("doc_id", "text_hash").distinct().join(groups, "text_hash")
    # texts without words are no copies of another id's
    lone = F.when(F.col("n") == 0, F.col("doc_id"))
    pairs = materialise(pairs.select("doc_id", "text_hash", F.xxhash64("component", F.col("doc_id").isNull(), lone).alias("grp")), "pairs")
    first = pairs.groupBy("grp").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("best")).filter("n > 1")
    goes = pairs.join(first, "grp").filter(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("best"))).select("doc_id", "text_hash")
    kept = keyed.join(goes, _same(keyed, goes), "left_anti")
    # of rows that repeat an id and its text one stays; they are told apart by nothing else
    again = keyed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_hash")
    once = kept.join(again, _same(kept, again), "left_anti").select(*docs.columns)
    by = [F.to_json(c) if c == OTHERS else F.col(c) for c in docs.columns if c != "doc_id"]
    w = Window.partitionBy("doc_id", "text_hash").orderBy(*by)
    more = kept.join(again, _same(kept, again), "left_semi").withColumn("nth", F.row_number().over(w)).filter("nth = 1").select(*docs.columns)
    return once.unionByName(more)


@apart
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten consecutive words with the benchmark."""
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    found = winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = found.filter("n_hit > 0").select("doc_id", "text_hash").distinct()
    return keyed.join(hit, _same(keyed, hit), "left_anti").select(*docs.columns)


@apart
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars to match."""
    clean = pii.redact(pii.find(docs))
    return clean.withColumn("n_chars", F.when(F.size("pii") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@apart
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text."""
    return bpe.encode(docs, tokenizer_path()).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]

#: Language models, components at a threshold and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
