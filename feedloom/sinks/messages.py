"""Notification messages (outbox rows) and dry-run plan text.

Posting is outside the engine: messages are rows appended to an outbox
table (:func:`feedloom.sinks.tables.append_outbox`) that a delivery process
reads; ids are deterministic so re-runs never queue duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, has_count
from ..operators.delta import message_id
from ..operators.rank import with_rank
from . import document as D
from .. import formats as FM


def go_quote(c) -> Column:
    """Double-quoted string with backslash escapes (quote, backslash, \\n, \\r, \\t)."""
    c = F.coalesce(col_(c), F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def comment_count_col(df: DataFrame) -> Column:
    return F.coalesce(F.col("comment_count"), F.lit(0)) if "comment_count" in df.columns else F.lit(0)


def notification_messages(items: DataFrame) -> DataFrame:
    """One post per item: text ``<url|title>``; attachment = description,
    a blank line, the bookmark count line and the comment count line."""
    cnt = F.coalesce(F.col("bookmark_count"), F.lit("")) if "bookmark_count" in items.columns else F.lit("")
    n = comment_count_col(items)
    attachment = F.concat(
        F.coalesce(F.col("description"), F.lit("")), F.lit("\n\n"),
        F.when(has_count(cnt), F.concat(F.lit(FM.ATTACH_COUNT_OPEN), cnt, F.lit(FM.ATTACH_COUNT_CLOSE))).otherwise(F.lit("")),
        F.when(n > 0, F.concat(F.lit(FM.ATTACH_COMMENTS), n.cast("string"), F.lit("\n"))).otherwise(F.lit("")))
    text = F.concat(F.lit("<"), F.coalesce(F.col("url"), F.lit("")), F.lit("|"),
                    F.coalesce(F.col("title"), F.lit("")), F.lit(">"))
    return items.select("pos", F.lit("post").alias("kind"), text.alias("text"), attachment.alias("attachment"),
                        message_id(F.lit("post"), F.col("pos").cast("string"), F.col("url")).alias("message_id"))


def dry_run_lines(items: DataFrame, channel: str = "") -> DataFrame:
    """Document rows of the posting plan: a header with the number of posts,
    then ``N. message title="..." url="..."`` per item in input order and,
    for items with a count, the count and comment-count line."""
    ch = channel or FM.UNSET_CHANNEL
    head = items.agg(F.count("*").alias("n")).select(
        F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("k3"),
        F.format_string(FM.DRY_RUN_HEADER.replace("%s", ch.replace("%", "%%")), F.col("n")).alias("line"))
    narrow = [c for c in ("pos", "title", "url", "bookmark_count", "comment_count") if c in items.columns]
    numbered = with_rank(items.select(*narrow), [F.col("pos").asc()], "_n")
    cnt = F.coalesce(F.col("bookmark_count"), F.lit("")) if "bookmark_count" in items.columns else F.lit("")
    first = D.lines(numbered, F.concat(F.col("_n").cast("string"), F.lit(FM.DRY_RUN_ITEM), go_quote("title"),
                                       F.lit(" url="), go_quote("url")), 1, F.col("_n"), 0)
    second = D.lines(numbered.filter(cnt != ""),
                     F.concat(F.lit(FM.DRY_RUN_COUNT), cnt, F.lit(FM.DRY_RUN_COMMENTS),
                              comment_count_col(numbered).cast("string")), 1, F.col("_n"), 1)
    return head.unionByName(first).unionByName(second)


def delta_dry_run_lines(plan: DataFrame, channel: str = "") -> DataFrame:
    """Document rows of the comment-delta dry run (per entry, then totals)."""
    ch = channel or FM.UNSET_CHANNEL
    per = D.lines(plan, F.concat(
        F.lit(FM.DELTA_DRY_RUN_ITEM), go_quote("title"), F.lit(" url="), go_quote("url"),
        F.lit(" parent_post="), F.when(F.col("parent_post"), F.lit("true")).otherwise(F.lit("false")),
        F.lit(" new_comments="), F.col("new_comments").cast("string")), 0, F.col("pos"), 0)
    tot = plan.agg(F.sum(F.col("parent_post").cast("long")).alias("p"),
                   F.coalesce(F.sum("new_comments"), F.lit(0)).alias("c"))
    summary = D.lines(tot, F.format_string(
        FM.DELTA_DRY_RUN_SUMMARY.replace("%s", ch.replace("%", "%%"), 1),
        F.coalesce(F.col("p"), F.lit(0)), F.col("c")), 1, 0, 0)
    return per.unionByName(summary)
