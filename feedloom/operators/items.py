"""Item-level projections: normalize, dedup key, ordered unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import dedup_key, with_normalized

# Input order as one number: the source among unioned ones, then the file, the
# place in the file and the row there.  Readers use the lower 104 bits; 22 bits
# are left for the source, which keeps the number within 38 digits.
ORDER = "decimal(38,0)"
FILE_BITS, PLACE_BITS, ROW_BITS = 31, 40, 33
SOURCE_STEP = 1 << (FILE_BITS + PLACE_BITS + ROW_BITS)


def order_value(file: Column, place: Column, row: Column) -> Column:
    """``pos`` of a row from its file's ordinal, its place in the file (block
    start or chunk number) and its number there."""
    number = lambda c: c.cast("decimal(20,0)").cast(ORDER)
    step = lambda bits: F.lit(str(1 << bits)).cast(ORDER)
    placed = ((number(file) * step(PLACE_BITS)).cast(ORDER) + number(place)).cast(ORDER)
    return ((placed * step(ROW_BITS)).cast(ORDER) + number(row)).cast(ORDER)


def stream_order_value(rank: Column, place: Column) -> Column:
    """``pos`` of the lines of a block of a streamed file, from the file's rank (63
    bits) and the place of the block.  The line's number in its block is added
    later: a line takes a byte at least, so it stays before the next block."""
    number = lambda c: c.cast("decimal(20,0)").cast(ORDER)
    return ((number(rank) * F.lit(str(1 << PLACE_BITS)).cast(ORDER)).cast(ORDER) + number(place)).cast(ORDER)


def key_col(df: DataFrame) -> Column:
    """Dedup key of each row (normalized_url, else normalize(url), else url)."""
    n = F.col("normalized_url") if "normalized_url" in df.columns else F.lit("")
    return dedup_key(n, F.col("url"))


def normalize_items(df: DataFrame) -> DataFrame:
    """Fill ``normalized_url`` when empty, then ``id`` when empty."""
    n = F.coalesce(F.col("normalized_url"), F.lit("")) if "normalized_url" in df.columns else F.lit("")
    df = with_normalized(df, F.when(n == "", F.col("url")).otherwise(F.lit("")), "_nnu")
    df = df.withColumn("normalized_url", F.when(n != "", n).otherwise(F.col("_nnu"))).drop("_nnu")
    i = F.coalesce(F.col("id"), F.lit("")) if "id" in df.columns else F.lit("")
    # after the fill the key is normalized_url, else the raw url
    key = F.when(F.col("normalized_url") != "", F.col("normalized_url")).otherwise(F.coalesce(F.col("url"), F.lit("")))
    return df.withColumn("id", F.when(i != "", i).otherwise(key))


def union_ordered(*dfs: DataFrame) -> DataFrame:
    """Union several item tables keeping a total order: all rows of the first
    input, then the second, ...

    ``pos`` is re-based by source.  A union tells in its ``pos`` column's
    metadata how many sources it has, so unions of unions do not collide."""
    parts, sources = [], 0
    for d in dfs:
        own = d.schema["pos"].metadata.get("sources", 1)
        step = F.lit(str(sources * SOURCE_STEP)).cast(ORDER)
        parts.append(d.withColumn("pos", (F.col("pos").cast(ORDER) + step).cast(ORDER)))
        sources += own
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.withColumn("pos", F.col("pos").alias("pos", metadata={"sources": sources}))


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Skip rows without an item (null url and title and id)."""
    return df.filter(F.col("url").isNotNull() | F.col("title").isNotNull() | F.col("id").isNotNull())
