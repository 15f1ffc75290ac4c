"""Registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import byte_bpe, decontamination, divergence, fingerprints, language_id, line_crf, line_dedup, prefix_trie, secret_scan, sharding, simhash, substring_dedup, warc
from feedloom.llm.oracle import ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return substring_dedup.dedup(docs, window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.versions(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                  _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents", "doc_id", "text"))
    n_base = len(secret_scan.BASE_RULES)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}")
              for r in secret_scan.BASE_RULES]
    base = F.filter("spans", lambda s: s["kind_order"] < n_base)
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages", "page_id", "url", "html"), least_bytes=100)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents", "doc_id", "text"), shards=40)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup.dedup(docs, passage=8).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs, k=4, radius=4).select("doc_id", "fingerprint", "component_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str,
                  vocabulary: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.digests(docs, vocabulary, public_tokenizers.PATTERN)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents", "lang", "source", "text"), min_docs=10, top=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.predict(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "quality"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup,
    op2_fingerprints,
    op3_decontamination,
    op4_language_id,
    op5_secret_scan,
    op6_warc,
    op7_sharding,
    op8_line_dedup,
    op9_simhash_near_dedup,
    op10_byte_bpe,
    op11_divergence,
    op12_prefix_trie,
    op13_quality,
)}

__all__ = ["ORACLE", "QUERIES"]
