"""Enrichers: bookmark/comment snapshot joins, page metadata and readable
text joins, source label, tags and the extractive summary.

Network lookups of the reference are re-aimed as joins with captured
snapshot tables (``bookmark_counts``, ``comments``, ``page_snapshots``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import meta_pairs, meta_value, page_title, readable_text
from ..functions.text import clean_truncate, first_non_blank, first_non_empty, go_trim, has_count
from ..session import send_pages

# Reason texts of the extractive summary.
SUMMARY_REASON_COUNT = "Hatena Bookmark: "
SUMMARY_REASON_SOURCE = "source: "
SUMMARY_REASON_DEFAULT = "source feed item"
DEFAULT_SUMMARY_RUNES = 160
MISSING_PAGE_ERROR = "page not captured"


def comment_counts(comments: DataFrame, on: str = "url") -> DataFrame:
    """(key, comment_count): partial-aggregated count per item key."""
    return comments.groupBy(on).agg(F.count("*").alias("comment_count"))


def lookup_key(on: str = "url") -> F.Column:
    """The column that items are looked up by.  Blank links are never found;
    they get keys of their own, so that they do not meet in one task."""
    return F.when(F.coalesce(F.col(on).cast("string"), F.lit("")) == "", F.concat(
        F.lit("\u0000"), F.col("pos").cast("string"))).otherwise(F.col(on).cast("string"))


def with_lookup(items: DataFrame, table: DataFrame, on: str = "url") -> DataFrame:
    """``items`` left joined with ``table`` by link."""
    table = table.withColumn("_lk", F.col(on).cast("string")).drop(on)
    return items.withColumn("_lk", lookup_key(on)).join(table, "_lk", "left").drop("_lk")


def bookmark_enrich(items: DataFrame, counts: DataFrame, comments: DataFrame,
                    on: str = "url") -> DataFrame:
    """Attach ``bookmark_count`` (text) and ``comment_count`` by raw link.

    A link missing from the count snapshot gives '' (lookup failed), a blank
    captured body gives '0'; items with an empty link are not looked up.
    Comments stay in their own table (joined again by link where needed);
    only their count travels with the item.
    """
    c = latest_captures(counts.withColumnRenamed(on, "url")).withColumnRenamed("url", on) \
        if "fetched_at" in counts.columns else counts
    c = c.select(F.col(on), F.col("count").alias("_cnt"))
    cc = comment_counts(comments, on)
    base = items.drop(*[x for x in ("comment_count",) if x in items.columns])
    j = with_lookup(with_lookup(base, c, on), cc, on)
    looked_up = F.coalesce(F.col(on), F.lit("")) != ""
    body = go_trim(F.col("_cnt"))
    count = F.when(~looked_up | F.col("_cnt").isNull(), F.lit("")).when(body == "", F.lit("0")).otherwise(body)
    return (j.withColumn("bookmark_count", count)
            .withColumn("comment_count", F.when(looked_up, F.coalesce(F.col("comment_count"), F.lit(0)))
                        .otherwise(F.lit(0)).cast("long"))
            .drop("_cnt"))


def source_label(df: DataFrame, default_source: str = "") -> DataFrame:
    """source = trim(source), else the default, else the author;
    ``source_label`` is set when the result is non-empty."""
    author = F.coalesce(F.col("author"), F.lit("")) if "author" in df.columns else F.lit("")
    src = go_trim(F.coalesce(F.col("source"), F.lit("")))
    src = F.when(src != "", src).otherwise(F.lit(default_source or ""))
    src = F.when(src != "", src).otherwise(author)
    return (df.withColumn("source", src)
            .withColumn("source_label", F.when(F.col("source") != "", F.col("source"))
                        .otherwise(F.col("source_label") if "source_label" in df.columns
                                   else F.lit(None).cast("string"))))


def comment_tags(comments: DataFrame, on: str = "url") -> DataFrame:
    """(key, _tags): distinct trimmed non-blank comment tags per item, in
    comment order.  Distinct per (key, tag) first, so the per-key list is
    bounded by the number of distinct tags."""
    t = comments.select(on, "ord", F.posexplode(F.coalesce(F.col("tags"), F.array().cast("array<string>")))
                        .alias("_ti", "_tag"))
    t = t.withColumn("_tag", go_trim(F.col("_tag"))).filter(F.col("_tag") != "")
    first = t.groupBy(on, "_tag").agg(F.min(F.struct("ord", "_ti")).alias("_o"))
    return first.groupBy(on).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_tag"))),
                                             lambda s: s["_tag"]).alias("_tags"))


def tag_enrich(items: DataFrame, comments: DataFrame, on: str = "url") -> DataFrame:
    """categories = existing ++ comment tags, trimmed, blanks dropped,
    case-sensitive distinct keeping first occurrence."""
    j = with_lookup(items, comment_tags(comments, on), on)
    merged = F.concat(F.coalesce(F.col("categories"), F.array().cast("array<string>")),
                      F.coalesce(F.col("_tags"), F.array().cast("array<string>")))
    merged = F.array_distinct(F.filter(F.transform(merged, lambda x: go_trim(x)), lambda x: x != ""))
    return j.withColumn("categories", merged).drop("_tags")


def _page_error(pages_status_col) -> F.Column:
    return F.concat(F.lit("http status "), pages_status_col.cast("string"))


def latest_captures(pages: DataFrame) -> DataFrame:
    """One capture per URL: with a ``fetched_at`` column the latest one
    (partial ``max_by`` aggregation, so a much-captured URL is reduced before
    the shuffle); without it the table is taken to hold one row per URL."""
    if "fetched_at" not in pages.columns:
        return pages
    cols = [c for c in pages.columns if c != "url"]
    return pages.groupBy("url").agg(F.max_by(F.struct(*cols), F.col("fetched_at")).alias("_p")).select("url", "_p.*")


def page_meta(pages: DataFrame) -> DataFrame:
    """Per captured page: the whitelisted meta values and the title."""
    send_pages(pages.sparkSession)
    pages = latest_captures(pages)
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    p = pages.select("url", "status", F.col("html").alias("_html"), meta_pairs("html").alias("_pairs"))
    pairs = F.col("_pairs")
    return p.select(
        "url", "status",
        F.when(ok, F.lit(None).cast("string")).otherwise(_page_error(F.col("status"))).alias("_err"),
        meta_value(pairs, "og:title").alias("og_title"),
        meta_value(pairs, "og:description").alias("og_description"),
        meta_value(pairs, "og:image").alias("og_image"),
        meta_value(pairs, "og:site_name").alias("og_site_name"),
        meta_value(pairs, "description").alias("meta_description"),
        page_title(F.col("_html")).alias("page_title"),
    )


META_COLUMNS = ["og_title", "og_description", "og_image", "og_site_name", "meta_description", "page_title"]


def ogp_enrich(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Left join page metadata by link.  Title/description are filled only
    when empty (og value first, then the plain one); a failed lookup sets
    ``ogp_error`` and keeps the row; empty links pass untouched."""
    meta = page_meta(pages).drop("status")
    j = with_lookup(items, meta.withColumn("_hit", F.lit(True)))
    looked = F.coalesce(F.col("url"), F.lit("")) != ""
    ok = looked & F.col("_hit").isNotNull() & F.col("_err").isNull()
    out = j.withColumn("ogp_error", F.when(looked & F.col("_hit").isNull(), F.lit(MISSING_PAGE_ERROR))
                       .when(looked, F.col("_err")))
    for c in META_COLUMNS:
        out = out.withColumn(c, F.when(ok & (F.col(c) != ""), F.col(c)))
    out = out.withColumn("title", F.when(ok & (F.coalesce(F.col("title"), F.lit("")) == ""),
                                         first_non_empty("og_title", "page_title")).otherwise(F.col("title")))
    out = out.withColumn("description", F.when(
        ok & (F.coalesce(F.col("description"), F.lit("")) == ""),
        first_non_empty("og_description", "meta_description")).otherwise(F.col("description")))
    return out.drop("_hit", "_err")


def page_text(pages: DataFrame) -> DataFrame:
    """Per captured page: readable text (or the lookup error)."""
    send_pages(pages.sparkSession)
    pages = latest_captures(pages)
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    return pages.select("url", "status", readable_text("html").alias("_text")).select(
        "url", F.when(ok, F.col("_text")).alias("_text"),
        F.when(ok, F.lit(None).cast("string")).otherwise(_page_error(F.col("status"))).alias("_err"))


def content_enrich(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Left join readable text by link: overwrite ``content`` and set
    ``content_text`` (even when empty); a failure sets ``content_error``."""
    t = page_text(pages).withColumn("_hit", F.lit(True))
    j = with_lookup(items, t)
    looked = F.coalesce(F.col("url"), F.lit("")) != ""
    ok = looked & F.col("_hit").isNotNull() & F.col("_err").isNull()
    return (j.withColumn("content_error", F.when(looked & F.col("_hit").isNull(), F.lit(MISSING_PAGE_ERROR))
                         .when(looked, F.col("_err")))
            .withColumn("content", F.when(ok, F.col("_text")).otherwise(F.col("content")))
            .withColumn("content_text", F.when(ok, F.col("_text")))
            .drop("_text", "_err", "_hit"))


def summarize(df: DataFrame, max_runes: int = DEFAULT_SUMMARY_RUNES) -> DataFrame:
    """Extractive summary: first non-empty of content/description/title,
    white space collapsed, cut to ``max_runes`` code points; reason from the
    bookmark count, else the source."""
    n = max_runes if max_runes and max_runes > 0 else DEFAULT_SUMMARY_RUNES
    summary = clean_truncate(first_non_blank("content", "description", "title"), n)
    count = F.coalesce(F.col("bookmark_count"), F.lit("")) if "bookmark_count" in df.columns else F.lit("")
    src = F.coalesce(F.col("source"), F.lit("")) if "source" in df.columns else F.lit("")
    reason = (F.when(has_count(count), F.concat(F.lit(SUMMARY_REASON_COUNT), count))
              .when(src != "", F.concat(F.lit(SUMMARY_REASON_SOURCE), src))
              .otherwise(F.lit(SUMMARY_REASON_DEFAULT)))
    return df.withColumn("summary", summary).withColumn("reading_reason", reason)


def summarize_with(df: DataFrame, summarizer) -> DataFrame:
    """Summary from a pluggable summarizer.

    ``summarizer(df)`` returns a Column ``struct<summary, reason, error>``
    (a built-in expression or an Arrow ``pandas_udf``).  A non-null error
    is written to ``summary_error`` and the row is kept unchanged."""
    s = df.withColumn("_sum", summarizer(df))
    err = F.col("_sum.error")
    ok = err.isNull()
    return (s.withColumn("summary", F.when(ok, F.coalesce(F.col("_sum.summary"), F.lit(""))).otherwise(F.col("summary")))
            .withColumn("reading_reason", F.when(ok, F.coalesce(F.col("_sum.reason"), F.lit("")))
                        .otherwise(F.col("reading_reason")))
            .withColumn("summary_error", err.cast("string"))
            .drop("_sum"))
