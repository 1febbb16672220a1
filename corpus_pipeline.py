"""From raw documents to a training mix: filter, dedupe, decontaminate, redact, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm.credentials import redact_credentials
from ratelens.llm.leakage import passage_leaks
from ratelens.llm.mixing import mix_families
from ratelens.llm.near_logs import near_copies
from ratelens.llm.toxicity import fit_toxicity, score_toxicity
from ratelens.session import spill

#: FTRL, MinHash and inferred automata are beyond SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


#: Column that no table of documents is expected to have.
KEY = "__key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that rows share only if they have the same ``doc_id`` and the same text.

    It is the ``doc_id``; a document without one gets a negative number that its
    text determines. Of several texts under one ``doc_id`` that with the least hash
    keeps it, and the others get numbers beyond all ids, from ``doc_id`` and text.
    """
    text = F.xxhash64("text", F.col("text").isNull())
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("__first"), F.max(text).alias("__last"))
    several = spill(several.where("__first != __last").select(F.col("doc_id").alias("__id"), "__first"), "ambiguous-ids")
    own = F.col("__first").isNull() | (text == F.col("__first"))
    beyond = F.lit(1 << 62) + F.abs(F.xxhash64("doc_id", "text") % (1 << 61))
    key = F.when(F.col("doc_id").isNull(), -F.abs(F.xxhash64("text") % (1 << 62)) - 2).when(own, F.col("doc_id")).otherwise(beyond)
    return docs.join(several, docs["doc_id"] == several["__id"], "left").select(*[docs[c] for c in docs.columns], key.alias(KEY))


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of :func:`_keyed` whose key is not among ``keys``."""
    left_out = spill(keys.select(F.col("item_id").alias(KEY)).distinct(), "left-out")
    return rows.join(left_out, KEY, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from labelled ones whose crc32(doc_id) mod 5 is not 0."""
    # The whole row goes along as one column, so that no extra column can clash.
    texts = docs.select(F.col("doc_id").alias("item_id"), "text", F.struct(*docs.columns).alias("document"))
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("item_id"), "toxic")
    held_out = F.crc32(F.col("item_id").cast("string").cast("binary")) % 5 == 0
    model = fit_toxicity(texts, marks.where(~held_out))
    scored = score_toxicity(texts, model, carry=("document",))
    return scored.where("score < 0.5").select("document.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-copies (five-word shingles, 80 %); repeated rows once."""
    rows = _keyed(docs)
    found = near_copies(rows.select(F.col(KEY).alias("item_id"), F.col("text").alias("log")))
    once = _without(rows, found.where("NOT kept"))
    keys = rows.groupBy(KEY).agg(F.count("*").alias("rows"))
    repeated = spill(keys.where("rows > 1").select(KEY), "repeated")
    return (
        once.join(repeated, KEY, "left_anti")
        .unionByName(once.join(repeated, KEY, "left_semi").dropDuplicates([KEY]))
        .select(*docs.columns)
    )


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of any benchmark item."""
    cases = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("case_id"), F.col("text").alias("passage")
    )
    rows = _keyed(docs)
    leaks = passage_leaks(rows.select(F.col(KEY).alias("item_id"), F.col("text").alias("log")), cases)
    return _without(rows, leaks.where("n_hit > 0")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials replaced by their kind in brackets; ``n_chars`` follows the text."""
    done = redact_credentials(docs, text="text")
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words that the mix takes of each document."""
    mixed = mix_families(docs, item="doc_id", family="source", text="text")
    return mixed.withColumnRenamed("family_size", "source_size")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
