"""Corpus pipeline: from raw documents to token ids, in five stages.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All stages but the last keep the columns of ``documents``.

1. language ID: documents that the language models reject go.
2. line dedup: lines of recurring templates go, everywhere but in the first
   document that has them; documents with nothing else go.
3. SimHash near-dedup: of each group the document with the smallest id stays; of
   passages (lines of 8 tokens or more) that these share, only the first copy, so
   that it is in a document that stays.
4. benchmark decontamination: documents that contain a benchmark item go.
5. byte-level BPE: token ids, and whether they decode to the text again.

Null or empty texts are rejected by the first stage; rows without an id pass all
stages on their own (they are in no group and in no count)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import byte_bpe, decontamination, language_id, line_dedup, simhash
from feedloom.llm.common import saved

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_recurring_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    repeated = saved(simhash.repeated_ids(docs, k=4, radius=4), "repeated-ids")
    return line_dedup.without_repeated_passages(docs, without=repeated)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids, round_trip)``."""
    tokenizer = byte_bpe.Tokenizer(spark, VOCABULARY, public_tokenizers.PATTERN)
    rows = docs.select(F.struct("doc_id", "lang", "source", "text").alias("row"), "text")
    out = tokenizer.encode(rows, id_col="row", decoded=True)
    return out.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      (F.col("decoded") == F.coalesce("row.text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

# Language models, SimHash and BPE are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
