"""Feed validity report (lint) as aggregations over parsed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from .. import formats as FM


def lint_errors(docs: DataFrame) -> DataFrame:
    """(source, n, error_line) for every invalid non-blank chunk; ``n`` is the
    chunk's 1-based number among the non-blank chunks of its source.

    The window is per source file, which is already a single task when the
    file is read as whole text, so it adds no skew of its own."""
    from pyspark.sql.window import Window
    nb = docs.filter(~F.col("blank")).withColumn(
        "n", F.row_number().over(Window.partitionBy("source").orderBy("chunk_idx")))
    return nb.filter(~F.col("valid")).select(
        "source", "n", F.format_string(FM.LINT_FEED_ERROR, F.col("n"), F.col("error")).alias("error_line"))


def lint(docs: DataFrame) -> DataFrame:
    """One row: total, valid, invalid, ok (whitespace-only chunks not counted)."""
    nb = docs.filter(~F.col("blank"))
    return nb.agg(F.count("*").alias("total"),
                  F.count_if(F.col("valid")).alias("valid"),
                  F.count_if(~F.col("valid")).alias("invalid")) \
        .withColumn("ok", F.col("invalid") == 0)


def merge_lint(*results: DataFrame) -> DataFrame:
    """Combine lint results: sums of the counters."""
    u = results[0]
    for r in results[1:]:
        u = u.unionByName(r)
    return u.agg(F.sum("total").alias("total"), F.sum("valid").alias("valid"),
                 F.sum("invalid").alias("invalid")).withColumn("ok", F.col("invalid") == 0)


def merge_lint_errors(*errors: DataFrame) -> DataFrame:
    """Error lists of several lint runs as one: (run, source, n, error_line), the
    runs in the order given."""
    parts = [e.select(F.lit(i).alias("run"), "source", "n", "error_line") for i, e in enumerate(errors)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lint_report(docs: DataFrame) -> DataFrame:
    """Report lines (ord, line): the counter line, then ``- feed N: msg``
    lines in source order; an ordered write of ``line`` gives the text."""
    head = lint(docs).select(F.lit(-1).cast("long").alias("source"), F.lit(0).cast("long").alias("n"),
                             F.format_string(FM.LINT_TOTALS, "total", "valid",
                                             "invalid").alias("line"))
    errs = lint_errors(docs).select("source", F.col("n").cast("long"),
                                    F.concat(F.lit("- "), F.col("error_line")).alias("line"))
    return head.unionByName(errs)


def lint_feed_bodies(bodies: DataFrame) -> DataFrame:
    """Per captured feed ``(feed_url, body)``: the whole body is one feed.
    Rows (feed_url, valid, error); a missing body is a failed fetch."""
    from ..sources.feeds import parse_feeds
    chunks = bodies.select(F.col("feed_url"), F.lit(0).cast("long").alias("source"),
                           F.lit(0).alias("chunk_idx"), F.coalesce(F.col("body"), F.lit("")).alias("chunk"),
                           F.col("body").isNull().alias("_missing"))
    parsed = parse_feeds(chunks.select("source", "chunk_idx", "chunk", "feed_url", "_missing"))
    return parsed.select(
        "feed_url",
        (F.col("valid") & ~F.col("_missing")).alias("valid"),
        F.when(F.col("_missing"), F.lit("fetch failed: empty feed"))
        .when(F.col("blank"), F.lit("Failed to detect feed type"))
        .otherwise(F.col("error")).alias("error"))


def lint_feed_report(results: DataFrame) -> DataFrame:
    """Report rows (k1, k2, line): the counter line, then ``- <url>: <error>``
    for every invalid feed, in feed URL order."""
    head = results.agg(F.count("*").alias("t"), F.count_if("valid").alias("v"),
                       F.count_if(~F.col("valid")).alias("i")).select(
        F.lit(0).cast("long").alias("k1"), F.lit("").alias("k2"),
        F.format_string(FM.LINT_TOTALS, "t", "v", "i").alias("line"))
    errs = results.filter(~F.col("valid")).select(
        F.lit(1).cast("long").alias("k1"), F.col("feed_url").alias("k2"),
        F.concat(F.lit("- "), F.col("feed_url"), F.lit(": "), F.col("error")).alias("line"))
    return head.unionByName(errs)
