"""Versioned tables: state, archive and outbox.

A versioned table lives under ``<path>/v=<n>``; readers take the highest
complete version (one with ``_SUCCESS``), writers create ``n+1``.  A job
therefore never overwrites the files it is reading, and a failed write
leaves the previous version in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import archive_key
from ..schema import STATE_SCHEMA


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _version_folders(spark: SparkSession, path: str) -> dict[int, bool]:
    """Number of every version folder, and whether it is complete."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return {}
    folders = [st.getPath() for st in fs.listStatus(p) if st.isDirectory()]
    return {int(f.getName()[2:]): fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))
            for f in folders if f.getName()[:2] == "v=" and f.getName()[2:].isdigit()}


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions under ``path`` (ascending)."""
    return sorted(n for n, complete in _version_folders(spark, path).items() if complete)


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Latest complete version, or an empty table with ``schema``."""
    vs = versions(spark, path)
    if not vs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/v={vs[-1]}")


def write_next(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write ``df`` as the next version; returns its number.  What a failed
    write left behind keeps its number and is never read."""
    n = max(_version_folders(df.sparkSession, path), default=0) + 1
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path.rstrip('/')}/v={n}")
    return n


class StateStore:
    """Per-entry comment state (entry_key, last_comment_timestamp, thread_id)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        return read_latest(self.spark, self.path, STATE_SCHEMA)

    def save(self, state: DataFrame) -> int:
        return write_next(state.select([f.name for f in STATE_SCHEMA.fields]), self.path)


def append_outbox(outbox: DataFrame, path: str) -> DataFrame:
    """Append messages not yet in the outbox table (by ``message_id``), so a
    re-run or a retried job never queues a message twice; of messages with one
    id in the input one is kept.  Returns the rows appended (lazy)."""
    spark = outbox.sparkSession
    fs, p, _ = _fs(spark, path)
    columns = outbox.columns
    new = outbox.groupBy("message_id").agg(F.min(F.struct(*columns)).alias("m")).select("m.*").select(*columns)
    if fs.exists(p):
        existing = spark.read.parquet(path).select("message_id")
        new = new.join(existing, "message_id", "left_anti").select(*columns)
    new.write.mode("append").parquet(path)
    return new


# Archives are cut into this many folders by a hash of the feed key, whatever
# the number of feeds; files are sorted by feed and published time.
ARCHIVE_BUCKETS = 256


def write_archive(items: DataFrame, path: str, feed_link_col: str = "feed_link") -> int:
    """Write items as the next archive version, with their feed key (the feed
    link without ``http(s)://``), newest first within a feed."""
    from ..functions.times import published_time
    df = items.withColumn("feed_key", archive_key(F.col(feed_link_col)))
    df = df.withColumn("bucket", F.pmod(F.xxhash64("feed_key"), F.lit(ARCHIVE_BUCKETS)).cast("int"))
    order = published_time(df).desc_nulls_last()
    df = df.repartitionByRange("bucket", "feed_key", order, "pos").sortWithinPartitions("bucket", "feed_key", order, "pos")
    return write_next(df, path, ["bucket"])


def read_archive(spark: SparkSession, path: str, schema: T.StructType, feed_key: str | None = None) -> DataFrame:
    """Latest archive version (of one feed: newest first); a missing archive is
    an empty table."""
    wanted = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    out = read_latest(spark, path, wanted)
    if feed_key is None:
        return out.drop("bucket")
    from ..operators.rank import sort_published
    bucket = F.pmod(F.xxhash64(F.lit(feed_key)), F.lit(ARCHIVE_BUCKETS)).cast("int")
    return sort_published(out.filter((F.col("bucket") == bucket) & (F.col("feed_key") == feed_key)).drop("bucket"))


def write_items_table(items: DataFrame, path: str, mode: str = "append") -> None:
    """Write items partitioned by ``published_date`` (UTC day of the
    published time; items without a time go to the null partition), so
    time-window filters prune whole partitions."""
    from ..functions.times import published_time
    (items.withColumn("published_date", F.to_date(published_time(items)))
     .write.mode(mode).partitionBy("published_date").parquet(path))
