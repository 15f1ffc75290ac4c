"""Filters.  Each is written once as a :class:`Rule` -- keep predicate,
derived columns and reason strings -- so execution (``filter``) and the
explain operator use the very same Column expressions."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import go_trim, keyword_score, matching_contains, prepare_patterns
from ..functions.times import duration_string, parse_duration, published_time, ts_lit
from ..functions.urls import domain_matches, domain_suffixes, item_domain, normalize_domain_list, with_domain
from .. import reasons as R


@dataclass
class Rule:
    stage: str
    keep: Column
    reasons: Column                      # array<string>
    derived: dict[str, Column] = field(default_factory=dict)
    identity: bool = False               # execution returns the input as is
    helpers: list[str] = field(default_factory=list)   # staged columns to drop
    barrier: bool = False                # keep the filter above expensive helpers


def _reasons(*cols: Column) -> Column:
    return F.filter(F.array(*cols), lambda x: x.isNotNull())


def optimizer_barrier(df: DataFrame, name: str = "_barrier") -> DataFrame:
    """Stop predicate pushdown at this point of the plan.

    Catalyst pushes a filter below the projection that computes the columns
    it reads and substitutes their expressions into the condition, once per
    reference.  For cheap columns that is what we want (it reaches the
    Parquet scan); for an expensive one (URL normalization, lowered full
    text) it multiplies the work.  A projection holding a non-deterministic
    value is never crossed by a pushed filter, so the expensive columns are
    computed exactly once.  The filter must read the marker (see
    :func:`behind_barrier`), otherwise column pruning removes it first."""
    return df.withColumn(name, F.spark_partition_id())


def behind_barrier(cond: Column, name: str = "_barrier") -> Column:
    """``cond`` plus a (always true) read of the barrier marker."""
    return cond & (F.col(name) >= 0)


def apply_rule(df: DataFrame, rule: Rule) -> DataFrame:
    if rule.identity:
        return df.drop(*rule.helpers)
    keep = rule.keep
    if rule.barrier:
        df = optimizer_barrier(df)
        keep = behind_barrier(keep)
    out = df.withColumns(rule.derived).filter(keep) if rule.derived else df.filter(keep)
    return out.drop(*rule.helpers, "_barrier")


# -- keyword ------------------------------------------------------------------

def keyword_text(df: DataFrame) -> Column:
    cats = F.array_join(F.coalesce(F.col("categories"), F.array().cast("array<string>")), " ") \
        if "categories" in df.columns else F.lit("")
    parts = [F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
             for c in ("title", "description", "content")]
    return F.lower(F.concat_ws(" ", *parts, cats))


def keyword_rule(df: DataFrame, include=None, exclude=None, min_score: int = 0) -> tuple[DataFrame, Rule]:
    include, exclude = list(include or []), list(exclude or [])
    inc, exc = prepare_patterns(include), prepare_patterns(exclude)
    # the lowered text is materialized once: the exclude match runs inside a
    # lambda, where an inline expression would be re-evaluated per pattern
    df = df.withColumn("_kw_text", keyword_text(df))
    text = F.col("_kw_text")
    score = keyword_score(text, inc)
    hits = matching_contains(text, exc)
    excluded = F.size(hits) > 0 if exc else F.lit(False)
    no_inc = (score == 0) if include else F.lit(False)
    below = (score < min_score) if min_score > 0 else F.lit(False)
    reasons = _reasons(
        F.when(excluded, F.concat(F.lit(R.KEYWORD_EXCLUDED), F.array_join(hits, ","))),
        F.when(no_inc, F.lit(R.KEYWORD_NO_INCLUDE)).otherwise(
            F.concat(F.lit(R.KEYWORD_SCORE), score.cast("string"))),
        F.when(below, F.lit(f"{R.KEYWORD_MIN_SCORE}{min_score}")),
    )
    return df, Rule("keyword_filter", ~excluded & ~no_inc & ~below, reasons,
                    {"keyword_score": score.cast("int")},
                    helpers=["_kw_text"], barrier=True)


def keyword_filter(df: DataFrame, include=None, exclude=None, min_score: int = 0) -> DataFrame:
    """Drop on any exclude hit; score = include patterns contained; drop when
    include is given and nothing matched, or when score < min_score."""
    return apply_rule(*keyword_rule(df, include, exclude, min_score))


# -- domain -------------------------------------------------------------------

def domain_col(df: DataFrame) -> Column:
    n = F.col("normalized_url") if "normalized_url" in df.columns else F.lit("")
    return item_domain(n, F.col("url"))


def _domain_table(t: DataFrame) -> DataFrame:
    """Pattern table: first column lowered, trimmed, one leading www.
    stripped, blanks dropped, distinct."""
    p = F.regexp_replace(F.lower(go_trim(F.col(t.columns[0]))), r"^www\.", "")
    return t.select(p.alias("_sfx")).filter(F.col("_sfx") != "").distinct()


def _suffix_flag(df: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Add boolean ``name``: the row's domain equals a pattern of ``table``
    or ends with '.' + pattern (equi-join on the domain's dotted suffixes)."""
    hits = (df.select("pos", F.explode(domain_suffixes(F.col("_dom"))).alias("_sfx"))
            .join(_domain_table(table), "_sfx", "left_semi").select("pos").distinct()
            .withColumn(name, F.lit(True)))
    return df.join(hits, "pos", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def domain_rule(df: DataFrame, include=None, exclude=None) -> tuple[DataFrame, Rule]:
    """Lists are literals; DataFrames (first column = domains) are matched
    by joins for lists too long to inline.  An empty include table, like an
    empty include list, applies no include filter."""
    df = with_domain(df, "_dom")
    d = F.col("_dom")
    empty = d == ""
    helpers = ["_dom"]
    if isinstance(exclude, DataFrame):
        df, helpers = _suffix_flag(df, exclude, "_exh"), helpers + ["_exh"]
        ex_hit, exc = F.col("_exh") & ~empty, True
    else:
        exc = normalize_domain_list(exclude)
        ex_hit = domain_matches(d, exc) & ~empty
    if isinstance(include, DataFrame):
        inc = _domain_table(include).limit(1).count() > 0
        if inc:
            df, helpers = _suffix_flag(df, include, "_inh"), helpers + ["_inh"]
        in_miss = ~F.col("_inh") if inc else F.lit(False)
    else:
        inc = normalize_domain_list(include)
        in_miss = (~domain_matches(d, inc)) if inc else F.lit(False)
    if inc:
        keep = ~empty & ~ex_hit & ~in_miss
    else:
        keep = empty | ~ex_hit
    reason = (F.when(empty & F.lit(bool(inc)), F.lit(R.DOMAIN_EMPTY))
              .when(ex_hit, F.concat(F.lit(R.DOMAIN_EXCLUDED), d))
              .when(in_miss, F.concat(F.lit(R.DOMAIN_INCLUDE_MISMATCH), d))
              .otherwise(F.concat(F.lit(R.DOMAIN_KEPT),
                                  F.when(empty, F.lit(R.DOMAIN_EMPTY_LABEL)).otherwise(d))))
    return df, Rule("domain_filter", keep, F.array(reason),
                    {"domain": F.when(~empty, d).otherwise(F.col("domain") if "domain" in df.columns
                                                            else F.lit(None).cast("string"))},
                    helpers=helpers, barrier=True)


def domain_filter(df: DataFrame, include=None, exclude=None) -> DataFrame:
    """Filter by the item's domain (equal or dotted-suffix match); exclude
    first, then include; an empty domain passes only without include."""
    return apply_rule(*domain_rule(df, include, exclude))


# -- time window --------------------------------------------------------------

def time_window_rule(df: DataFrame, since, now) -> tuple[DataFrame, Rule]:
    ns = parse_duration(since)
    if ns <= 0:
        return df, Rule("time_window_filter", F.lit(True),
                        F.array(F.lit(R.TIME_NO_WINDOW)), identity=True)
    now_dt = now if isinstance(now, _dt.datetime) else _dt.datetime.fromisoformat(str(now))
    cutoff = ts_lit(now_dt - _dt.timedelta(microseconds=ns // 1000))
    pub = published_time(df)
    text = duration_string(ns)
    keep = pub.isNotNull() & (pub >= cutoff)
    if "published_at" in df.columns:
        # implied by `keep` (a non-null published_at is the published time),
        # and simple enough to reach the Parquet scan: row groups whose
        # published_at statistics lie before the window are skipped
        keep = (F.col("published_at").isNull() | (F.col("published_at") >= cutoff)) & keep
    if "published_date" in df.columns:
        # tables written by write_items_table: prune date partitions too
        keep = (F.col("published_date").isNull() | (F.col("published_date") >= F.to_date(cutoff))) & keep
    reason = (F.when(pub.isNull(), F.lit(R.TIME_MISSING))
              .when(pub < cutoff, F.lit(R.TIME_OLDER + text))
              .otherwise(F.lit(R.TIME_WITHIN + text)))
    return df, Rule("time_window_filter", keep, F.array(reason))


def time_window(df: DataFrame, since, now) -> DataFrame:
    """Keep items published at or after ``now - since``; items without a time
    are dropped, future items kept; ``since <= 0`` keeps everything."""
    return apply_rule(*time_window_rule(df, since, now))


# -- min hotness --------------------------------------------------------------

def _fmt3(x: float) -> str:
    return f"{x:.3f}"


def min_hotness_rule(df: DataFrame, minimum: float) -> tuple[DataFrame, Rule]:
    score = F.coalesce(F.col("hotness_score"), F.lit(0.0)) if "hotness_score" in df.columns else F.lit(0.0)
    s_txt = F.format_string("%.3f", score)
    if minimum > 0:
        keep = score >= F.lit(float(minimum))
        reason = F.when(~keep, F.concat(F.lit(f"{R.MIN_HOTNESS_DROPPED}{_fmt3(minimum)}{R.MIN_HOTNESS_DROPPED_SCORE}"), s_txt)) \
            .otherwise(F.concat(F.lit(R.MIN_HOTNESS_SCORE), s_txt))
        return df, Rule("min_hotness", keep, F.array(reason))
    return df, Rule("min_hotness", F.lit(True), F.array(F.concat(F.lit(R.MIN_HOTNESS_SCORE), s_txt)),
                    identity=True)


def min_hotness(df: DataFrame, minimum: float) -> DataFrame:
    """Keep items whose (3-decimal) hotness score is >= minimum."""
    return apply_rule(*min_hotness_rule(df, minimum))


# -- favourite users ----------------------------------------------------------

def watch_list(users) -> list[str]:
    return [u.strip().lower() for u in (users or []) if u and u.strip()]


def fav_users_table(comments: DataFrame, users, on: str = "url") -> DataFrame:
    """(key, fav_users): matched comment users per item, distinct
    case-insensitively (first spelling wins), in comment order, ','-joined.

    Pre-aggregated per (key, user) before the per-key collect, so a key's
    list is bounded by the size of the watch list."""
    c = comments.withColumn("_lu", F.lower(F.col("user")))
    if isinstance(users, DataFrame):
        # a watch table (too large for literals): semi join on the lowered
        # user; the planner broadcasts it only when its actual size is small
        w = users.select(F.lower(go_trim(F.col(users.columns[0]))).alias("_lu")).filter(F.col("_lu") != "")
        c = c.join(w.distinct(), "_lu", "left_semi")
    else:
        c = c.filter(F.col("_lu").isin(watch_list(users)))
    m = (c.groupBy(on, "_lu")
         .agg(F.min("ord").alias("_first"), F.min_by("user", "ord").alias("_user")))
    return m.groupBy(on).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_first", "_user"))), lambda s: s["_user"]), ",").alias("fav_users"))


def fav_user_rule(df: DataFrame, comments: DataFrame, users, on: str = "url") -> tuple[DataFrame, Rule]:
    users = users if isinstance(users, DataFrame) else list(users or [])
    watch = users if isinstance(users, DataFrame) else watch_list(users)
    if not isinstance(watch, DataFrame) and not watch:
        keep = F.lit(not users)
        reason = F.lit(R.FAV_NONE_CONFIGURED) if not users else F.lit(R.FAV_NO_MATCH)
        return df, Rule("fav_user", keep, F.array(reason), identity=True)
    fav = fav_users_table(comments, users, on).withColumnRenamed("fav_users", "_fav")
    joined = df.join(fav, on, "left")
    keep = F.col("_fav").isNotNull()
    reason = F.when(keep, F.concat(F.lit(R.FAV_MATCHED), F.col("_fav"))).otherwise(
        F.lit(R.FAV_NO_MATCH))
    return joined, Rule("fav_user", keep, F.array(reason), {"fav_users": F.col("_fav")}, helpers=["_fav"])


def fav_user(df: DataFrame, comments: DataFrame, users, on: str = "url") -> DataFrame:
    """Keep items commented by a watched user; sets ``fav_users``.  ``users``
    is a list, or a DataFrame whose first column holds the user names."""
    if not isinstance(users, DataFrame) and not watch_list(users):
        return df
    fav = fav_users_table(comments, users, on)
    base = df.drop("fav_users") if "fav_users" in df.columns else df
    return base.join(fav, on, "inner")
