"""Stages and chains: the declarative surface over the operators.

A :class:`Stage` has a ``name`` and ``apply(df, ctx) -> df``; a chain runs
with :func:`run_stages` (``functools.reduce`` over ``DataFrame.transform``),
building one lazy plan that Catalyst optimizes as a whole.  Stages are built
from a config dict with :func:`build_stages` (aliases as in the reference)
or from flag-style options with :func:`filter_rank_stages`.
"""

from __future__ import annotations

import datetime as _dt
import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame

from ..functions.times import duration_string, parse_duration
from ..operators import dedup, enrich, filters, rank
from ..operators.items import normalize_items
from ..operators.plugin import DEFAULT_STDERR_LIMIT, external_command
from .. import reasons as R


@dataclass
class Context:
    """Inputs shared by the stages of one run (one ``now`` per run)."""
    now: _dt.datetime = field(default_factory=lambda: _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))
    comments: DataFrame | None = None
    bookmark_counts: DataFrame | None = None
    pages: DataFrame | None = None
    on: str = "url"


def comments_for(df: DataFrame, ctx: Context):
    """(comments table, join column) for a stage: the run's comments
    snapshot (joined by link), else the items' own ``comments`` arrays
    (JSON input), normalized and joined by ``pos``; None when neither."""
    if ctx.comments is not None:
        return ctx.comments, ctx.on
    if "comments" in df.columns:
        from ..sources.jsonl import comments_from_items
        return comments_from_items(df, on="pos"), "pos"
    return None, ctx.on


class Stage:
    name = "stage"
    kind = "dry_run"          # transform | filter | merge | rank | dry_run
    explain_text = R.UNKNOWN_STAGE

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        raise NotImplementedError

    def __repr__(self):
        return f"{type(self).__name__}({self.name})"


class NormalizeStage(Stage):
    name, kind, explain_text = "normalize", "transform", R.NORMALIZE

    def apply(self, df, ctx):
        return normalize_items(df)


class MergeStage(Stage):
    name, kind = "merge", "merge"

    def __init__(self, keep_empty_keys: bool = False):
        self.keep_empty_keys = keep_empty_keys

    def apply(self, df, ctx):
        return dedup.merge_items(df, self.keep_empty_keys)


class DiffStage(Stage):
    """Drop items whose key occurs in ``existing``."""
    name, kind = "diff", "dry_run"
    explain_text = "diff: would drop items present in the existing set"

    def __init__(self, existing: DataFrame):
        self.existing = existing

    def apply(self, df, ctx):
        return dedup.diff_items(df, self.existing)


class BookmarkStage(Stage):
    name, kind, explain_text = "hatena_bookmark", "dry_run", R.HATENA_BOOKMARK

    def apply(self, df, ctx):
        if ctx.bookmark_counts is None or ctx.comments is None:
            raise ValueError("hatena_bookmark stage needs bookmark_counts and comments snapshots")
        return enrich.bookmark_enrich(df, ctx.bookmark_counts, ctx.comments, ctx.on)


class KeywordStage(Stage):
    name, kind = "keyword_filter", "filter"

    def __init__(self, include=None, exclude=None, min_score: int = 0):
        self.include, self.exclude, self.min_score = list(include or []), list(exclude or []), int(min_score or 0)

    def rule(self, df, ctx):
        return filters.keyword_rule(df, self.include, self.exclude, self.min_score)

    def apply(self, df, ctx):
        return filters.keyword_filter(df, self.include, self.exclude, self.min_score)


class DomainStage(Stage):
    name, kind = "domain_filter", "filter"

    def __init__(self, include=None, exclude=None):
        # lists of domains, or DataFrames of domains for long lists
        keep_df = lambda v: v if isinstance(v, DataFrame) else list(v or [])
        self.include, self.exclude = keep_df(include), keep_df(exclude)

    def rule(self, df, ctx):
        return filters.domain_rule(df, self.include, self.exclude)

    def apply(self, df, ctx):
        return filters.domain_filter(df, self.include, self.exclude)


class TimeWindowStage(Stage):
    name, kind = "time_window_filter", "filter"

    def __init__(self, since, now: _dt.datetime | None = None):
        self.since_ns = parse_duration(since)
        self.now = now

    def rule(self, df, ctx):
        return filters.time_window_rule(df, self.since_ns / 1e9, self.now or ctx.now)

    def apply(self, df, ctx):
        return filters.time_window(df, self.since_ns / 1e9, self.now or ctx.now)


class HotnessStage(Stage):
    name, kind = "hotness_score", "filter"

    def __init__(self, now: _dt.datetime | None = None):
        self.now = now

    def rule(self, df, ctx):
        from pyspark.sql import functions as F
        score = rank.hotness_expr(df, self.now or ctx.now)
        return df, filters.Rule(self.name, F.lit(True),
                                F.array(F.concat(F.lit(R.HOTNESS_SCORE), F.format_string("%.3f", score))),
                                {"hotness_score": score})

    def apply(self, df, ctx):
        return rank.hotness_score(df, self.now or ctx.now)


class MinHotnessStage(Stage):
    name, kind = "min_hotness", "filter"

    def __init__(self, minimum: float = 0.0):
        self.minimum = float(minimum or 0.0)

    def rule(self, df, ctx):
        return filters.min_hotness_rule(df, self.minimum)

    def apply(self, df, ctx):
        return filters.min_hotness(df, self.minimum)


class FavUserStage(Stage):
    name, kind = "fav_user", "filter"

    def __init__(self, users=None):
        # a list of names, or a DataFrame of names for large watch lists
        self.users = users if isinstance(users, DataFrame) else list(users or [])

    def _empty(self) -> bool:
        return not isinstance(self.users, DataFrame) and not filters.watch_list(self.users)

    def _comments(self, df, ctx):
        c, on = comments_for(df, ctx)
        if c is None:
            raise ValueError("fav_user stage needs a comments table or items with comments")
        return c, on

    def rule(self, df, ctx):
        if self._empty():
            return filters.fav_user_rule(df, None, self.users, ctx.on)
        c, on = self._comments(df, ctx)
        return filters.fav_user_rule(df, c, self.users, on)

    def apply(self, df, ctx):
        if self._empty():
            return df
        c, on = self._comments(df, ctx)
        return filters.fav_user(df, c, self.users, on)


class RankStage(Stage):
    name, kind = "rank", "rank"

    def __init__(self, by: str = "", top: int | None = None):
        self.by, self.top = by or "", top

    def apply(self, df, ctx):
        return rank.rank(df, self.by, self.top)


class SourceLabelStage(Stage):
    name, kind, explain_text = "source_label", "transform", R.SOURCE_LABEL

    def __init__(self, default_source: str = ""):
        self.default_source = default_source or ""

    def apply(self, df, ctx):
        return enrich.source_label(df, self.default_source)


class TagStage(Stage):
    name, kind, explain_text = "tag", "transform", R.TAG

    def apply(self, df, ctx):
        c, on = comments_for(df, ctx)
        if c is None:
            return df
        return enrich.tag_enrich(df, c, on)


class OgpStage(Stage):
    name, kind, explain_text = "ogp", "dry_run", R.OGP

    def apply(self, df, ctx):
        if ctx.pages is None:
            raise ValueError("ogp stage needs the page snapshots table")
        return enrich.ogp_enrich(df, ctx.pages)


class ContentStage(Stage):
    name, kind = "content", "dry_run"
    explain_text = R.CONTENT

    def apply(self, df, ctx):
        if ctx.pages is None:
            raise ValueError("content stage needs the page snapshots table")
        return enrich.content_enrich(df, ctx.pages)


class SummaryStage(Stage):
    name, kind, explain_text = "summary", "transform", R.SUMMARY

    def __init__(self, max_runes: int = enrich.DEFAULT_SUMMARY_RUNES):
        self.max_runes = max_runes

    def apply(self, df, ctx):
        return enrich.summarize(df, self.max_runes)


class ExternalCommandStage(Stage):
    kind = "dry_run"

    def __init__(self, name: str, command: str, args=None, env=None, timeout=None,
                 stderr_limit: int = DEFAULT_STDERR_LIMIT):
        self.name = name or "plugin"
        self.command, self.args, self.env = command, list(args or []), list(env or [])
        self.timeout_ns = parse_duration(timeout) if timeout else 0
        self.stderr_limit = stderr_limit or DEFAULT_STDERR_LIMIT

    @property
    def explain_text(self):
        r = R.PLUGIN_DRY_RUN + self.command
        if self.args:
            r += R.PLUGIN_ARGS + " ".join(self.args)
        if self.timeout_ns > 0:
            r += R.PLUGIN_TIMEOUT + duration_string(self.timeout_ns)
        return r

    def apply(self, df, ctx):
        t = f"{self.timeout_ns}ns" if self.timeout_ns else None
        return external_command(df, self.command, self.args, self.env, t, self.stderr_limit, self.name)


class FunctionStage(Stage):
    """Any ``DataFrame -> DataFrame`` callable as a named stage."""
    kind = "dry_run"

    def __init__(self, name: str, fn: Callable[[DataFrame], DataFrame]):
        self.name, self.fn = name, fn

    def apply(self, df, ctx):
        return self.fn(df)


def execution_order(stages: list[Stage]) -> list[Stage]:
    """Stages as they are executed: among neighbouring row filters the time
    window goes first.  It is the cheapest, and only below the expensive ones
    does its bound reach the Parquet scan.  (The filters read no column that
    another one writes, so their order does not change the rows kept; explain
    keeps the written order.)"""
    out: list[Stage] = []
    for stage in stages:
        at = len(out)
        if isinstance(stage, TimeWindowStage):
            while at and isinstance(out[at - 1], (KeywordStage, DomainStage)):
                at -= 1
        out.insert(at, stage)
    return out


def run_stages(df: DataFrame, stages: list[Stage], ctx: Context | None = None) -> DataFrame:
    """Apply stages in order (lazy; errors surface at build or action time)."""
    ctx = ctx or Context()
    return reduce(lambda acc, st: acc.transform(lambda d: st.apply(d, ctx)), execution_order(stages), df)


class tagged_run:
    """Context manager tagging every Spark job started inside it, so another
    thread can cancel the run with :func:`cancel_run` (the chain itself is
    lazy: jobs start at the sink action)."""

    def __init__(self, spark, tag: str):
        self.spark, self.tag = spark, tag

    def __enter__(self):
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, *exc):
        self.spark.sparkContext.removeJobTag(self.tag)
        return False


def cancel_run(spark, tag: str) -> None:
    """Cancel the running jobs of a tagged run (from any thread)."""
    spark.sparkContext.cancelJobsWithTag(tag)


# --------------------------------------------------------- config builder ---

# Stage type aliases accepted in a chain config.
STAGE_ALIASES = {
    "normalize": "normalize",
    "merge": "merge",
    "hatena_bookmark": "hatena_bookmark", "hatena-bookmark": "hatena_bookmark", "hatena": "hatena_bookmark",
    "keyword_filter": "keyword", "keyword-filter": "keyword", "keyword": "keyword",
    "domain_filter": "domain", "domain-filter": "domain", "domain": "domain",
    "time_window": "time_window", "time-window": "time_window", "since": "time_window",
    "hotness_score": "hotness", "hotness-score": "hotness", "hotness": "hotness",
    "min_hotness": "min_hotness", "min-hotness": "min_hotness",
    "fav_user": "fav_user", "fav-user": "fav_user",
    "rank": "rank",
    "source_label": "source_label", "source-label": "source_label", "source": "source_label",
    "tag": "tag", "tags": "tag",
    "ogp": "ogp",
    "content": "content", "readability": "content",
    "summary": "summary", "local_summary": "summary", "local-llm-summary": "summary",
    "plugin": "plugin", "external": "plugin", "external_command": "plugin",
    "external-command": "plugin", "command": "plugin",
}


def _window_from(spec: dict) -> Stage:
    if not str(spec.get("since") or "").strip():
        raise ValueError(f"{_kind_text(spec).lower()} stage requires since")
    return TimeWindowStage(spec["since"])


def _command_from(spec: dict) -> Stage:
    text = str(spec.get("timeout") or "").strip()
    try:
        limit = f"{parse_duration(text)}ns" if text and parse_duration(text) else None
    except ValueError as e:
        raise ValueError(f"invalid timeout for stage {_kind_text(spec)!r}: {e}") from None
    label = next((v for v in (str(spec.get(k) or "").strip() for k in ("name", "type")) if v), "")
    return ExternalCommandStage(label, spec.get("command", ""), spec.get("args"), spec.get("env"), limit,
                                spec.get("stderr_limit", 0))


# How a stage is built from its spec, by kind.
_BUILDERS: dict[str, Callable[[dict], Stage]] = {
    "content": lambda spec: ContentStage(),
    "domain": lambda spec: DomainStage(spec.get("include"), spec.get("exclude")),
    "fav_user": lambda spec: FavUserStage(spec.get("users")),
    "hatena_bookmark": lambda spec: BookmarkStage(),
    "hotness": lambda spec: HotnessStage(),
    "keyword": lambda spec: KeywordStage(spec.get("include"), spec.get("exclude"), spec.get("min_score", 0)),
    "merge": lambda spec: MergeStage(),
    "min_hotness": lambda spec: MinHotnessStage(spec.get("min", 0.0)),
    "normalize": lambda spec: NormalizeStage(),
    "ogp": lambda spec: OgpStage(),
    "plugin": _command_from,
    "rank": lambda spec: RankStage(spec.get("by", "")),
    "source_label": lambda spec: SourceLabelStage(spec.get("default_source", "")),
    "summary": lambda spec: SummaryStage(),
    "tag": lambda spec: TagStage(),
    "time_window": _window_from,
}


def _kind_text(spec: dict) -> str:
    return (spec.get("type") or "").strip() or (spec.get("name") or "").strip()


def stage_from_spec(spec: dict) -> Stage:
    text = _kind_text(spec)
    kind = STAGE_ALIASES.get(text.lower())
    if kind is None:
        raise ValueError(f"unsupported pipeline stage {text!r}")
    return _BUILDERS[kind](spec)


def build_stages(config) -> list[Stage]:
    """Stages from a chain config (dict, or JSON text) with ``stages: [...]``."""
    if isinstance(config, str):
        try:
            config = json.loads(config)
        except json.JSONDecodeError as e:
            raise ValueError(f"cannot read the stage list as JSON: {e}") from None
    return [stage_from_spec(s) for s in (config.get("stages") or [])]


def filter_rank_stages(include=None, exclude=None, min_score: int = 0,
                       include_domain=None, exclude_domain=None, since=None,
                       rank_by: str = "", min_hotness: float = 0.0, fav_users=None,
                       now: _dt.datetime | None = None) -> list[Stage]:
    """Flag-style builder in the fixed order keyword -> domain -> time ->
    hotness -> min_hotness -> fav_user -> rank (hotness is added when
    ranking by hotness or when min_hotness > 0)."""
    out: list[Stage] = []
    if include or exclude or min_score > 0:
        out.append(KeywordStage(include, exclude, min_score))
    if include_domain or exclude_domain:
        out.append(DomainStage(include_domain, exclude_domain))
    since_ns = parse_duration(since) if since not in (None, "") else 0
    if since_ns > 0:
        out.append(TimeWindowStage(f"{since_ns}ns", now))
    mode = (rank_by or "").strip().lower()
    if mode == "hotness" or min_hotness > 0:
        out.append(HotnessStage(now))
    if min_hotness > 0:
        out.append(MinHotnessStage(min_hotness))
    if fav_users:
        out.append(FavUserStage(fav_users))
    if mode:
        out.append(RankStage(rank_by))
    return out


# Enrich type aliases accepted by the enrich list.
ENRICH_STAGES = {"source_label": SourceLabelStage, "source-label": SourceLabelStage,
                 "source": SourceLabelStage, "tag": TagStage, "tags": TagStage, "ogp": OgpStage,
                 "content": ContentStage, "readability": ContentStage, "summary": SummaryStage,
                 "local_summary": SummaryStage, "local-llm-summary": SummaryStage}


def enrich_stages(names) -> list[Stage]:
    out = []
    for n in names or []:
        key = (n or "").strip().lower()
        if key not in ENRICH_STAGES:
            raise ValueError(f"unsupported enrich {n!r}")
        out.append(ENRICH_STAGES[key]())
    return out


def chain_stages(config=None, enrich=None, **filter_rank) -> list[Stage]:
    """A whole run's stages in order: configured stages, then the enrich
    list, then the flag-style filter/rank stages (the same order explain
    evaluates them in)."""
    return [*(build_stages(config) if config else []), *enrich_stages(enrich or []),
            *filter_rank_stages(**filter_rank)]


# ------------------------------------------------------------- whole config ---

@dataclass
class RunConfig:
    """The ``input`` and ``output`` blocks of a chain config, and its stages."""
    input_format: str = "feed"
    paths: list[str] = field(default_factory=list)
    output: str = "rss"
    digest_title: str = ""
    digest_window: str = "24h"
    channel: str = ""
    dry_run: bool = False
    stages: list[Stage] = field(default_factory=list)


def read_config(config) -> RunConfig:
    """A whole chain config (dict, or JSON text); absent values keep their
    defaults.  ``input.urls`` are paths of captured feeds or item files."""
    config = json.loads(config) if isinstance(config, str) else config
    into, out = config.get("input") or {}, config.get("output") or {}
    named = lambda block, key, default: (block.get(key) or "").strip().lower() or default
    run = RunConfig(named(into, "format", "feed"), list(into.get("urls") or []), named(out, "type", "rss"),
                    out.get("digest_title") or "", out.get("digest_window") or "24h", out.get("slack_channel") or "",
                    bool(out.get("slack_dry_run")), build_stages(config))
    if run.input_format not in ("feed", "jsonl"):
        raise ValueError(f"no reader for input format {run.input_format!r}")
    try:
        parse_duration(run.digest_window)
    except ValueError as e:
        raise ValueError(f"output.digest_window {run.digest_window!r}: {e}") from None
    return run


def run_config(spark, config, ctx: Context | None = None) -> DataFrame:
    """Read, run the stages, and render: document rows (``k1, k2, k3, line``) of
    the output type, or ``(pos, line)`` for JSON Lines."""
    from ..operators.explain import explain_items
    from ..operators.items import union_ordered
    from ..sinks import digest, feeds, jsonl, messages
    from ..sources.feeds import read_feeds
    from ..sources.jsonl import read_items_jsonl
    run, ctx = read_config(config), ctx or Context()
    read = {"feed": read_feeds, "jsonl": read_items_jsonl}[run.input_format]
    if not run.paths:
        raise ValueError("the config names no input")
    items = union_ordered(*[read(spark, p) for p in run.paths]) if len(run.paths) > 1 else read(spark, run.paths[0])
    outputs = {
        "rss": lambda df: feeds.rss_lines(df, ctx.comments, ctx.now),
        "atom": lambda df: feeds.atom_lines(df, ctx.comments, ctx.now),
        "json": jsonl.json_array_lines,
        "jsonl": jsonl.jsonl_records,
        "digest": lambda df: digest.digest_lines(df, ctx.now, run.digest_title, run.digest_window),
        "slack": lambda df: messages.dry_run_lines(df, run.channel) if run.dry_run else messages.notification_messages(df),
    }
    if run.output == "explain":
        return jsonl.explain_records(explain_items(items, run.stages, ctx))
    if run.output not in outputs:
        raise ValueError(f"no writer for output type {run.output!r}")
    return outputs[run.output](run_stages(items, run.stages, ctx))
