"""Sharding by jump consistent hashing, in SQL expressions only.

A row's shard follows from its key and the number of shards; there is no table
of shards.  Appending a shard moves only the rows that the new one takes.  The
generator is the published one: a 64-bit linear congruential sequence seeded by
the key, whose leading bits give the next jump."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.llm.common import saved

# Fixed values of jump consistent hashing.
MULTIPLIER = 2862933555777941757
MODULUS = 1 << 64
FIRST_STEPS = 64
CHUNK_IDS = 1 << 18
PLACE = ["doc_id", "text_crc32", "size"]


def jump_hash(key: str, shards: int) -> Column:
    """Shard of the long column ``key`` (read as unsigned) among ``shards``.

    Decimals hold the 64-bit products without overflow.  A row jumps about
    ``ln(shards)`` times, at most ``shards`` times; steps after its last jump
    change nothing, and steps beyond the first 64 are listed only where needed."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    following = f"cast((s.key * {MULTIPLIER}BD + 1BD) % {MODULUS}BD as decimal(20, 0))"
    step = (f"(s, i) -> if(s.j < {shards}, named_struct('b', s.j, 'j', cast((s.j + 1) * (2147483648D / "
            f"cast(({following}) div {1 << 33}BD + 1 as double)) as bigint), 'key', {following}), s)")
    seed = f"cast({key} as decimal(20, 0)) + if({key} < 0, {MODULUS}BD, 0BD)"
    out = (f"aggregate(sequence(1, {min(shards, FIRST_STEPS)}), "
           f"named_struct('b', -1L, 'j', 0L, 'key', cast({seed} as decimal(20, 0))), {step})")
    if shards > FIRST_STEPS:
        out = f"aggregate(if(({out}).j < {shards}, sequence(1, {shards}), array()), {out}, {step})"
    return F.expr(f"cast(({out}).b as int)")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, size, text_crc32, law, shard,
    slot, grown_shard)``.

    ``size`` is the UTF-8 length plus 16 and ``text_crc32`` the unsigned checksum
    (null texts: as empty ones).  The law is ``key``: id and number of shards
    decide, ``grown_shard`` is the shard with one more.  Null ids count as key 0
    and come first.  ``slot`` numbers a shard's rows from 0 by id, checksum and
    size.  Equal rows are counted before they are numbered and listed again
    afterwards, and the numbering is done by ranges of about as many rows: each range counts
    its rows per shard, and offsets come from these counts.  Other columns are
    ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32")) \
        .groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = saved(rows, "shard-rows")
    chunks = max(1, math.ceil(rows.count() / CHUNK_IDS))
    rows = saved(rows.repartitionByRange(chunks, *PLACE).withColumn("chunk", F.spark_partition_id()), "shard-chunks")
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(0))) \
        .withColumn("shard", jump_hash("key", shards)).withColumn("grown_shard", jump_hash("key", shards + 1)).drop("key")
    counts = rows.groupBy("shard", "chunk").agg(F.sum("n").alias("own"))
    upto = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = counts.select("shard", "chunk", (F.sum("own").over(upto) - F.col("own")).alias("offset"))
    within = W.partitionBy("shard", "chunk").orderBy(*PLACE).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("last", F.sum("n").over(within)).join(offsets, ["shard", "chunk"])
    first = F.col("offset") + F.col("last") - F.col("n")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), "grown_shard")
