"""The registered queries of this subpackage, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.llm import (
    ann, bpe, decontam, langid, license_scan, minhash, mixing, pii, prefix_trie, runs, secret_scan,
    sharding, spans, spotsigs,
)

SHARDS = 40


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _span_report(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    col = F.col("spans")
    return found.select(
        "doc_id",
        *(spans.count_kind(col, k).alias(f"n_{k}") for k in kinds),
        F.sha2(spans.spelled(spans.base_only(col)), 256).alias("base_sha256"),
        spans.spelled(col).alias("spans"),
    )


def tokenizer(spark: SparkSession, most_words: int = bpe.MOST_WORDS) -> bpe.Tokenizer:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.Tokenizer(spark, ranks, public_tokenizers.PATTERN, most_words)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = tokenizer(spark)
    coded = _documents(spark, sf_dir).select("doc_id", coder.encode(F.col("text")).alias("ids"))
    return coded.select(
        "doc_id", bpe.count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(coder.decode(F.col("ids")), 256).alias("decoded_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(
        _documents(spark, sf_dir), F.array("source"), mixing.words(F.col("text")), tie=F.xxhash64("text"))
    return mixed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_report(secret_scan.find_secrets(_documents(spark, sf_dir)), ("assign", "access", "hex"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, 20)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_report(pii.find_pii(_documents(spark, sf_dir)), pii.KINDS)


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_neighbours(_documents(spark, sf_dir))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), width=3, threshold=85)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan(_documents(spark, sf_dir)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.build(prefix_trie.rebuilt(prefix_trie.sequences(turns)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.detect(_documents(spark, sf_dir), runs.looped))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(_documents(spark, sf_dir))
    return decontam.report(decontam.find(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_mixing": op2_mixing,
        "op3_language_id": op3_language_id,
        "op5_nn_descent": op5_nn_descent,
        "op6_sharding": op6_sharding,
        "op4_secret_scan": op4_secret_scan,
        "op7_pii": op7_pii,
        "op8_spotsigs": op8_spotsigs,
        "op10_license_scan": op10_license_scan,
        "op9_superminhash": op9_superminhash,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_decontamination": op13_decontamination,
    }


def all_oracles() -> dict[str, str]:
    return {}
