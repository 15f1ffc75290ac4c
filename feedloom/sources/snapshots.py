"""Captured snapshot tables that stand in for network lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import COMMENT_STRUCT

COMMENTS_BODY_SCHEMA = f"struct<bookmarks:array<{COMMENT_STRUCT.simpleString()}>>"


def comments_from_bodies(comments_raw: DataFrame) -> DataFrame:
    """Comments table from captured API bodies ``comments_raw(url, body)``
    (``{"bookmarks": [...]}``); a missing/empty body yields no comments."""
    parsed = comments_raw.select("url", F.from_json(F.col("body"), COMMENTS_BODY_SCHEMA).alias("b"))
    c = parsed.select("url", F.posexplode(F.coalesce(F.col("b.bookmarks"),
                                                      F.array().cast(f"array<{COMMENT_STRUCT.simpleString()}>")))
                      .alias("ord", "c"))
    return c.select("url", F.col("ord").cast("long").alias("ord"), F.col("c.user").alias("user"),
                    F.col("c.comment").alias("comment"), F.col("c.timestamp").alias("timestamp"),
                    F.coalesce(F.col("c.tags"), F.array().cast("array<string>")).alias("tags"))


def page_snapshots(pages: DataFrame) -> DataFrame:
    """Normalize a captured pages table to (url, status, html)."""
    cols = pages.columns
    status = F.col("status").cast("int") if "status" in cols else F.lit(200)
    return pages.select("url", status.alias("status"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
