"""Markdown digest as ordered document rows."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, escape_md_link, go_trim, has_count, html_unescape
from ..functions.times import duration_string, parse_duration, published_time, rfc3339
from ..operators.filters import time_window
from . import document as D
from .. import formats as FM

# Fixed values of the digest format.
DEFAULT_TITLE = "feedloom digest"
DEFAULT_WINDOW = "24h"
SUMMARY_LIMIT = 180
_MAX_LONG = (1 << 63) - 1


def digest_summary(c, plain: bool = False):
    """Unescape, trim, collapse white space, cut at 180 characters + '...'
    (the digest keeps 180 characters and takes no room for the dots).  With
    ``plain`` the text is unescaped and clean already."""
    n = SUMMARY_LIMIT
    return F.transform(F.array(c if plain else clean_text(html_unescape(c))), lambda t: F.when(F.char_length(t) <= n, t).otherwise(
        F.concat(F.substring(t, 1, n), F.lit("..."))))[0]


def digest_lines(items: DataFrame, now: _dt.datetime, title: str = DEFAULT_TITLE,
                 window=DEFAULT_WINDOW) -> DataFrame:
    """Rows (k1, k2, k3, line) of the digest; items in the window, newest
    first, input order on ties."""
    spark = items.sparkSession
    title = title or DEFAULT_TITLE
    ns = parse_duration(window) if window not in (None, "") else 0
    kept = time_window(items, f"{ns}ns", now) if ns > 0 else items
    head = [f"# {title}", ""]
    if ns > 0:
        start = now - _dt.timedelta(microseconds=ns // 1000)
        fmt = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
        head += [f"Window: {fmt(start)} - {fmt(now)}", ""]
    n_line = kept.agg(F.count("*").alias("n")).select(
        F.lit(0).cast("long").alias("k1"), F.lit(len(head)).cast("long").alias("k2"),
        F.lit(0).cast("long").alias("k3"), F.concat(F.lit(FM.DIGEST_ITEMS), F.col("n").cast("string")).alias("line"))
    blank = D.header(spark, "", k1=0).withColumn("k2", F.lit(len(head) + 1).cast("long"))
    pub = published_time(kept)
    t = go_trim(F.coalesce(F.col("title"), F.lit("")))
    label = F.when(t == "", F.coalesce(F.col("url"), F.lit(""))).otherwise(t)
    cnt = F.coalesce(F.col("bookmark_count"), F.lit("")) if "bookmark_count" in kept.columns else F.lit("")
    bullet = F.concat(
        F.lit("- ["), escape_md_link(label), F.lit("]("), F.coalesce(F.col("url"), F.lit("")), F.lit(")"),
        F.when(pub.isNotNull(), F.concat(F.lit(" - "), rfc3339(pub))).otherwise(F.lit("")),
        F.when(has_count(cnt), F.concat(F.lit(FM.DIGEST_COUNT), cnt)).otherwise(F.lit("")))
    summ = digest_summary(F.coalesce(F.col("description"), F.lit("")))
    k2 = F.when(pub.isNull(), F.lit(_MAX_LONG)).otherwise(-F.unix_micros(pub))
    # bullet and summary lines of an item come out of one pass
    it = kept.select(F.col("pos"), k2.alias("_k2"), bullet.alias("_bullet"), summ.alias("_summ"))
    pair = F.array(F.struct((F.col("pos") * 2).alias("k3"), F.col("_bullet").alias("line")),
                   F.when(F.col("_summ") != "", F.struct((F.col("pos") * 2 + 1).alias("k3"),
                                                        F.concat(F.lit("  "), F.col("_summ")).alias("line"))))
    rows = it.select(F.lit(1).cast("long").alias("k1"), F.col("_k2").alias("k2"),
                     F.explode(F.filter(pair, lambda x: x.isNotNull())).alias("_l")) \
        .select("k1", "k2", F.col("_l.k3").alias("k3"), F.col("_l.line").alias("line"))
    return D.header(spark, *head, k1=0).unionByName(n_line).unionByName(blank).unionByName(rows)


def window_text(window) -> str:
    return duration_string(parse_duration(window))
