"""The document pipeline: stages applied one after the other to ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.llm import bpe, langid, minhash, mixing, pii
from salesprism.llm.queries import tokenizer
from salesprism.session import stage

KEPT_WORDS = 300_000  # of a worker: the stages before have filled the executor's memory by then
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go (null text or no letter); ``lang`` is filled where it is null."""
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = docs.select(*COLUMNS, langid.language(F.col("text"), model, spark).alias("_found"))
    kept = found.where(F.col("_found.lang") != langid.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "_found.lang")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8 or more)."""
    return minhash.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every row stays."""
    found = docs.select(*COLUMNS, pii.pii_spans(F.col("text")).alias("_spans"))
    clean = found.withColumn("text", pii.redact(F.col("text"), F.col("_spans")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per copy that the mixture takes; those it does not take go."""
    carry = F.struct(*(F.col(c) for c in COLUMNS))
    mixed = mixing.mix(docs, F.array("source"), mixing.words(F.col("text")), carry=carry, tie=F.xxhash64("text"))
    copies = mixed.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return copies.select("carry.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and whether they decode to it again."""
    coder = tokenizer(spark, KEPT_WORDS)
    coded = docs.select("doc_id", "source", "lang", coder.encode_and_check(F.col("text")).alias("_c"))
    return coded.select(
        "doc_id", "source", "lang", bpe.count(F.col("_c.ids")).alias("n_tokens"), "_c.ids", F.col("_c.same").alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
