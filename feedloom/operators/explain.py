"""Row provenance: why each input item was kept or dropped.

One output row per **input** item.  Stages run on all rows with an
``_alive`` flag instead of being filtered, so a dropped item records no
later stage; filter stages reuse the exact
:class:`~feedloom.operators.filters.Rule` Columns of execution.  Enrichers
that would read external data (ogp, content, bookmarks, plug-ins) are
reported as dry runs, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session as _session
from ..schema import EXPLAIN_JSONL_VERSION
from ..functions.urls import with_key
from .rank import rank_keys, with_rank
from .. import reasons as R

STAGE_STRUCT = "struct<stage:string,kept:boolean,reasons:array<string>>"
_HELPERS = ("_alive", "_stages", "_orig")


def _append(df: DataFrame, stage: str, kept: Column, reasons: Column) -> DataFrame:
    """Record a stage on alive rows and clear ``_alive`` where not kept."""
    alive = F.col("_alive")
    rec = F.struct(F.lit(stage).alias("stage"), kept.alias("kept"), reasons.alias("reasons")).cast(STAGE_STRUCT)
    # `_alive` references the previous flag once per stage: a filter on the
    # final flag is pushed down by inlining it, which must stay linear
    return df.withColumns({
        "_stages": F.when(alive, F.array_append(F.col("_stages"), rec)).otherwise(F.col("_stages")),
        "_alive": alive & kept,
    })


def explain_items(items: DataFrame, stages, ctx=None, output: str = "rss",
                  errors: list[str] | None = None) -> DataFrame:
    """Explain records (schema_version, output, pos, kept, reasons, stages, item)."""
    from ..plans.stages import Context
    ctx = ctx or Context()
    item_cols = list(items.columns)
    df = items.withColumns({
        "_alive": F.lit(True),
        "_stages": F.array().cast(f"array<{STAGE_STRUCT}>"),
        "_orig": F.struct(*[F.col(c) for c in item_cols]),
    })
    keys: list[Column] | None = None     # current order (None = input order)
    for st in stages:
        if st.kind == "filter":
            df, rule = st.rule(df, ctx)
            df = df.withColumns({"_keep": rule.keep, "_why": rule.reasons})
            derived = {}
            for k, v in rule.derived.items():
                old = F.col(k) if k in df.columns else F.lit(None).cast(df.select(v.alias("_t")).schema["_t"].dataType)
                derived[k] = F.when(F.col("_alive") & F.col("_keep"), v).otherwise(old)
                if k not in item_cols:
                    item_cols.append(k)
            df = _append(df.withColumns(derived), st.name, F.col("_keep"), F.col("_why"))
            df = df.drop("_keep", "_why", *rule.helpers)
        elif st.kind == "transform":
            prev = [c for c in df.columns if c not in _HELPERS]
            tmp = df.withColumns({f"_prev_{c}": F.col(c) for c in prev})
            after = st.apply(tmp, ctx)
            fresh = [c for c in after.columns if c not in tmp.columns]
            after = after.withColumns({c: F.when(F.col("_alive"), F.col(c)).otherwise(F.col(f"_prev_{c}"))
                                       for c in prev if c in after.columns})
            if fresh:
                after = after.withColumns({c: F.when(F.col("_alive"), F.col(c)) for c in fresh})
            df = _append(after.drop(*[f"_prev_{c}" for c in prev]), st.name, F.lit(True),
                         F.array(F.lit(st.explain_text)))
            item_cols += [c for c in fresh if c not in item_cols]
        elif st.kind == "merge":
            df = _explain_merge(df, keys)
        elif st.kind == "rank":
            mode = (st.by or "").strip().lower()
            try:
                k = rank_keys(df, st.by)
            except ValueError:
                df = _append(df, "rank", F.lit(False), F.array(F.lit(R.RANK_UNSUPPORTED + st.by)))
                continue
            if k is not None:
                keys = k
            df = _append(df, "rank", F.lit(True), F.array(F.lit(R.RANK_BY + mode)))
        else:
            df = _append(df, st.name, F.lit(True), F.array(F.lit(st.explain_text)))

    pre = [F.lit(R.BUILDER_ERROR + e) for e in (errors or [])]
    if not stages:
        reasons = F.array(*pre, F.lit(R.NO_CRITERIA))
    else:
        flat = F.flatten(F.transform(F.col("_stages"), lambda s: s["reasons"]))
        reasons = F.concat(F.array(*pre), flat) if pre else flat
    current = F.struct(*[F.col(c) for c in item_cols])
    original = F.struct(*[(F.col("_orig")[c] if c in items.columns
                           else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in item_cols])
    return df.select(
        F.lit(EXPLAIN_JSONL_VERSION).alias("schema_version"),
        F.lit(output or "rss").alias("output"),
        F.col("pos"),
        F.col("_alive").alias("kept"),
        reasons.alias("reasons"),
        F.col("_stages").alias("stages"),
        F.when(F.col("_alive"), current).otherwise(original).alias("item"),
    )


def _explain_merge(df: DataFrame, keys: list[Column] | None) -> DataFrame:
    """First alive row per key (in the current order) is kept.  An empty key
    becomes ``__index_<i>``, i = the row's 0-based index among alive rows,
    so empty-key rows are never merged."""
    keys = keys or [F.col("pos")]
    spark = df.sparkSession
    _session.checkpoint_dir(spark)
    df = with_key(df, "_k").withColumn("_o", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    df = df.checkpoint(eager=True)   # cut lineage: the plan below reads df three times
    if df.filter(F.col("_alive") & (F.col("_k") == "")).limit(1).count():
        alive = df.filter(F.col("_alive")).select("pos", "_k", *[F.col("_o")[f"k{i}"].alias(f"_o{i}")
                                                                for i in range(len(keys))])
        idx = with_rank(alive, [F.col(f"_o{i}").asc() for i in range(len(keys))], "_i")
        idx = idx.filter(F.col("_k") == "").select("pos", "_i")
        df = df.join(idx, "pos", "left").withColumn(
            "_k", F.when(F.col("_i").isNotNull(), F.concat(F.lit(R.EMPTY_KEY_PREFIX), (F.col("_i") - 1).cast("string")))
            .otherwise(F.col("_k"))).drop("_i")
    first = df.filter(F.col("_alive")).groupBy("_k").agg(F.min_by("pos", "_o").alias("_first"))
    df = df.join(first, "_k", "left")
    kept = F.col("pos") == F.col("_first")
    reason = F.when(kept, F.concat(F.lit(R.MERGE_KEPT), F.col("_k"))).otherwise(
        F.concat(F.lit(R.MERGE_DROPPED), F.col("_k")))
    df = df.withColumns({"_mk": kept, "_mr": F.array(reason)})
    return _append(df, "merge", F.col("_mk"), F.col("_mr")).drop("_k", "_o", "_first", "_mk", "_mr")
