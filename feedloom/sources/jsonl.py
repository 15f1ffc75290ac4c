"""JSON Lines items reader (one item per line, versioned records)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import parse_rfc3339
from ..functions.urls import with_normalized
from ..operators.items import ROW_BITS, order_value
from ..schema import COMMENT_STRUCT, ITEM_JSONL_VERSION, JSONL_ITEM_SCHEMA

ACCEPTED_VERSIONS = (ITEM_JSONL_VERSION,)
MAX_BROADCAST_FILES = 50_000
_SCHEME = r"^([A-Za-z0-9+.-]+):/+"  # file names come with one or three slashes


def parse_item_lines(lines: DataFrame, col: str = "value", accepted=ACCEPTED_VERSIONS,
                     pos=None) -> DataFrame:
    """Parse JSON lines into the items table; blank lines are skipped, a
    malformed line or an unknown ``schema_version`` fails the job (raised
    when the data is read, naming the offending record).  ``pos`` is the
    column that orders the lines."""
    line = F.trim(F.col(col))
    x = lines.filter(line != "").withColumn("_pos", F.monotonically_increasing_id() if pos is None else pos)
    ok_json = F.try_parse_json(F.col(col)).isNotNull() & F.startswith(F.ltrim(F.col(col)), F.lit("{"))
    rec = F.from_json(F.col(col), JSONL_ITEM_SCHEMA)
    ver = F.coalesce(rec["schema_version"], F.lit(""))
    check = (F.when(~ok_json, F.raise_error(F.concat(F.lit("jsonl: invalid record: "), F.substring(F.col(col), 1, 200))))
             .when((ver != "") & ~ver.isin(*accepted),
                   F.raise_error(F.concat(F.lit('jsonl: unsupported schema_version "'), ver, F.lit('"')))))
    x = x.withColumn("_r", F.when(check.isNull(), rec))
    r = lambda n: F.coalesce(F.col("_r." + n), F.lit(""))
    # normalized_url filled when missing (staged projections), then the key
    x = with_normalized(x, F.when(r("normalized_url") == "", r("url")).otherwise(F.lit("")), "_nu")
    url = r("url")
    n = F.when(r("normalized_url") != "", r("normalized_url")).otherwise(F.col("_nu"))
    key = F.when(n != "", n).otherwise(url)
    return x.select(
        F.col("_pos").alias("pos"),
        F.when(r("id") != "", r("id")).otherwise(key).alias("id"),
        url.alias("url"), n.alias("normalized_url"),
        r("title").alias("title"), r("description").alias("description"), r("content").alias("content"),
        parse_rfc3339(F.col("_r.published_at")).alias("published_at"),
        parse_rfc3339(F.col("_r.updated_at")).alias("updated_at"),
        F.lit("").alias("published_raw"), F.lit("").alias("updated_raw"), F.lit("").alias("author"),
        r("source").alias("source"),
        F.coalesce(F.col("_r.categories"), F.array().cast("array<string>")).alias("categories"),
        r("summary").alias("summary"), r("reading_reason").alias("reading_reason"),
        r("hatena_bookmark_count").alias("bookmark_count"),
        F.coalesce(F.col("_r.metadata"), F.create_map().cast("map<string,string>")).alias("metadata"),
        F.coalesce(F.col("_r.hatena_bookmark_comments"),
                   F.array().cast(f"array<{COMMENT_STRUCT.simpleString()}>")).alias("comments"),
    )


def row_in_task() -> Column:
    """Number of a row within its task; rows of one file block keep their order."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def read_items_jsonl(spark: SparkSession, path, accepted=ACCEPTED_VERSIONS) -> DataFrame:
    """Items from JSON Lines files, in order of file name and line.

    Spark packs file blocks into tasks by size, so the scan order is not the
    input order: ``pos`` is made of the file's rank by name, the start of the
    block and the row within it."""
    raw = spark.read.text(path)
    files = [(re.sub(_SCHEME, r"\1:/", f), i) for i, f in enumerate(sorted(raw.inputFiles()))]
    names = spark.createDataFrame(files, "_file string, _rank long")
    if len(files) <= MAX_BROADCAST_FILES:  # else a plain join
        names = F.broadcast(names)
    lines = raw.select("value", F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "$1:/").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"), row_in_task().alias("_row"))
    lines = lines.join(names, "_file", "left")
    return parse_item_lines(lines, "value", accepted, order_value(F.col("_rank"), F.col("_block"), F.col("_row")))


def comments_from_items(items: DataFrame, on: str = "url") -> DataFrame:
    """Normalized comments table from an items table carrying a ``comments``
    array (JSON input); ``ord`` keeps the order inside each item."""
    columns = dict.fromkeys([on, "pos"])
    c = items.select(*columns, F.posexplode("comments").alias("_i", "_c"))
    # several items may share a link; an item's own comments are numbered already
    order = F.col("_i").cast("long") if on == "pos" else (
        F.row_number().over(Window.partitionBy(on).orderBy("pos", "_i")).cast("long") - 1)
    return c.select(on, order.alias("ord"),
                    F.col("_c.user").alias("user"), F.col("_c.comment").alias("comment"),
                    F.col("_c.timestamp").alias("timestamp"), F.col("_c.tags").alias("tags"))


def jsonl_errors(spark: SparkSession, path, accepted=ACCEPTED_VERSIONS) -> DataFrame:
    """(file, line, error) for every bad line of JSON Lines files, with
    1-based line numbers counted like a line scanner (blank lines count).

    Line numbers without a single-task pass: every row gets its file block
    and its index inside the read partition; a per-block line-count table
    (one row per file block) gives each block's first line number."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    raw = raw.withColumn("_i", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    blocks = raw.groupBy("file", "_blk", "_pid").agg(F.count("*").alias("_n"), F.min("_i").alias("_i0"))
    blocks = blocks.withColumn("_first", F.coalesce(F.sum("_n").over(
        Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    line = F.trim(F.col("value"))
    ok_json = F.try_parse_json(F.col("value")).isNotNull() & F.startswith(F.ltrim(F.col("value")), F.lit("{"))
    ver = F.coalesce(F.get_json_object(F.col("value"), "$.schema_version"), F.lit(""))
    err = (F.when(line == "", F.lit(None))
           .when(~ok_json, F.lit("invalid JSON record"))
           .when((ver != "") & ~ver.isin(*accepted), F.concat(F.lit('unsupported schema_version "'), ver, F.lit('"'))))
    bad = raw.withColumn("error", err).filter(F.col("error").isNotNull())
    return bad.join(blocks.select("file", "_blk", "_pid", "_first", "_i0"), ["file", "_blk", "_pid"]) \
        .select("file", (F.col("_first") + F.col("_i") - F.col("_i0")).alias("line"),
                F.concat(F.lit("jsonl line "), (F.col("_first") + F.col("_i") - F.col("_i0")).cast("string"),
                         F.lit(": "), F.col("error")).alias("error"))
