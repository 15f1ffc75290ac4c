"""Explicit schemas and wire-format versions (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

# Wire-format versions written by this library.  Readers accept a
# configurable set (see feedloom.sources.jsonl.read_items_jsonl).
ITEM_JSONL_VERSION = "feedloom.feed_item.v1"
EXPLAIN_JSONL_VERSION = "feedloom.explain.v1"

COMMENT_STRUCT = T.StructType([
    T.StructField("user", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

# The working `items` table.  `pos` is the total input order (ties in sorts,
# "first wins" in dedup).  Strings are '' when absent; times stay nullable.
ITEM_FIELDS = [
    T.StructField("pos", T.LongType(), False),
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("normalized_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("published_raw", T.StringType()),
    T.StructField("updated_raw", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("reading_reason", T.StringType()),
    T.StructField("bookmark_count", T.StringType()),
]
ITEM_SCHEMA = T.StructType(ITEM_FIELDS)

# Normalized comments table: one row per bookmark comment, joined to items
# by the item's raw link (`url`); `ord` is the order inside one item.
COMMENTS_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("user", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

BOOKMARK_COUNTS_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("count", T.StringType()),
])

PAGES_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("html", T.StringType()),
])

STATE_SCHEMA = T.StructType([
    T.StructField("entry_key", T.StringType()),
    T.StructField("last_comment_timestamp", T.StringType()),
    T.StructField("thread_id", T.StringType()),
])

# JSON Lines record of one item (item fields inlined + schema_version).
JSONL_ITEM_SCHEMA = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("normalized_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("reading_reason", T.StringType()),
    T.StructField("hatena_bookmark_count", T.StringType()),
    T.StructField("hatena_bookmark_comments", T.ArrayType(COMMENT_STRUCT)),
])

STRING_ITEM_COLUMNS = [f.name for f in ITEM_FIELDS
                       if isinstance(f.dataType, T.StringType)]
