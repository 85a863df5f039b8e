"""The registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, jaccard, licences, lm, mix, quality, resample, shard, substrings, token_counts, token_ids, vectors
from .common import crc_fold, shared_dir
from .oracles import ORACLE_SQL  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_prefix_free_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_substrings(_read(spark, sf_dir, "documents")).drop("kept")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 5) == 0)


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 7)
    return lm.deleted_interpolation(docs, fold != 2, fold == 5)


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op6_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.pivotal_mix(_read(spark, sf_dir, "documents"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.hilbert_shards(_read(spark, sf_dir, "documents"))


def op9_rare_token_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


def op10_pigeonhole_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.restore(fim.fill_in_middle(_read(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op13_patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    token_ids.write_ids(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_ids.documents(spark, path)


QUERIES = {f.__name__: f for f in (op1_prefix_free_substrings, op2_ngram_jaccard, op3_attention_quality, op4_deleted_interpolation, op5_trie_token_counts, op6_subspace_pigeonhole, op7_pivotal_mix, op8_hilbert_shards, op9_rare_token_licences, op10_pigeonhole_edits, op11_importance_resample, op12_fill_in_middle, op13_patched_frames)}
