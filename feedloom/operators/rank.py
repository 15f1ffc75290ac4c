"""Hotness score and ranking."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_count
from ..functions.times import age_hours, published_time, ts_lit
from .. import session as _session

# Fixed values of the hotness formula:
#   bookmarks * 1.5 + comments * 2.0 + 10 * 24 / (age_hours + 24)
# age_hours = max(now - published, 0); 24 when the item has no time.
BOOKMARK_WEIGHT = 1.5
COMMENT_WEIGHT = 2.0
FRESHNESS_WEIGHT = 10.0
FRESHNESS_HALF_LIFE_H = 24.0


def comment_count_col(df: DataFrame) -> Column:
    if "comment_count" in df.columns:
        return F.coalesce(F.col("comment_count"), F.lit(0))
    if "comments" in df.columns:
        return F.coalesce(F.size(F.col("comments")), F.lit(0))
    return F.lit(0)


def hotness_expr(df: DataFrame, now) -> Column:
    now_c = ts_lit(now) if not isinstance(now, Column) else now
    bookmarks = parse_count(F.col("bookmark_count")) if "bookmark_count" in df.columns else F.lit(0)
    age = F.greatest(F.lit(0.0), F.coalesce(age_hours(published_time(df), now_c), F.lit(24.0)))
    h = F.lit(FRESHNESS_HALF_LIFE_H)
    raw = (bookmarks.cast("double") * F.lit(BOOKMARK_WEIGHT)
           + comment_count_col(df).cast("double") * F.lit(COMMENT_WEIGHT)
           + F.lit(FRESHNESS_WEIGHT) * (h / (age + h)))
    return F.round(raw, 3)


def hotness_score(df: DataFrame, now) -> DataFrame:
    """Set ``hotness_score`` (double, rounded to 3 decimals)."""
    return df.withColumn("hotness_score", hotness_expr(df, now))


def rank_order(df: DataFrame, by: str | None) -> list[Column] | None:
    """Sort columns for a rank mode; None = keep order; ValueError if unknown."""
    mode = (by or "").strip().lower()
    if mode in ("", "none"):
        return None
    if mode == "hotness":
        score = F.coalesce(F.col("hotness_score"), F.lit(0.0)) if "hotness_score" in df.columns else F.lit(0.0)
        return [score.desc(), F.col("pos").asc()]
    if mode in ("published", "time"):
        return [published_time(df).desc_nulls_last(), F.col("pos").asc()]
    raise ValueError(f"unsupported rank {by!r}")


def rank(df: DataFrame, by: str | None, top: int | None = None) -> DataFrame:
    """Stable global sort by hotness or published time (missing last).

    ``top`` keeps the first k rows (an orderBy+limit, planned as a
    per-partition top-k followed by one small merge)."""
    order = rank_order(df, by)
    if order is None:
        out = df
    else:
        out = df.orderBy(*order)
    return out.limit(top) if top else out


def sort_published(df: DataFrame) -> DataFrame:
    """Published time desc (missing last), input order on ties."""
    return df.orderBy(published_time(df).desc_nulls_last(), F.col("pos").asc())


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of every row in ``order`` without a
    single-partition window.

    The sorted (range-partitioned) rows are tagged with their partition id
    and in-partition index and checkpointed to the shared checkpoint folder;
    a per-partition count (one row per partition, so its size is bounded by
    the partition count) gives the offsets, which are broadcast back.
    """
    spark = df.sparkSession
    _session.checkpoint_dir(spark)
    tagged = (df.orderBy(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    counts = tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
    from pyspark.sql.window import Window
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    idx = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(name, (F.col("_off") + idx + 1).cast("long"))
            .drop("_pid", "_mid", "_off"))


def rank_keys(df: DataFrame, by: str | None) -> list[Column] | None:
    """Ascending sort keys equivalent to :func:`rank_order` (usable inside a
    struct for ``min_by`` or for :func:`with_rank`)."""
    mode = (by or "").strip().lower()
    if mode in ("", "none"):
        return None
    if mode == "hotness":
        score = F.coalesce(F.col("hotness_score"), F.lit(0.0)) if "hotness_score" in df.columns else F.lit(0.0)
        return [-score, F.col("pos")]
    if mode in ("published", "time"):
        pub = published_time(df)
        return [pub.isNull(), -F.unix_micros(pub), F.col("pos")]
    raise ValueError(f"unsupported rank {by!r}")
