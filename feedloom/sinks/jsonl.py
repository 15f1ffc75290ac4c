"""JSON / JSON Lines writers for items and explain records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import rfc3339
from ..functions.urls import normalize_url
from ..schema import EXPLAIN_JSONL_VERSION, ITEM_JSONL_VERSION
from . import document as D

# Typed working columns folded into the item's `metadata` map on output, with
# the metadata key each one is written under (fixed key names).
METADATA_COLUMNS = [
    ("keyword_score", "keyword_score"), ("domain", "domain"), ("hotness_score", "hotness_score"),
    ("fav_users", "fav_users"), ("source_label", "source_label"), ("ogp_error", "ogp_error"),
    ("og_title", "og:title"), ("og_description", "og:description"), ("og_image", "og:image"),
    ("og_site_name", "og:site_name"), ("meta_description", "description"), ("page_title", "title"),
    ("content_error", "content_error"), ("content_text", "content_text"),
    ("summary_error", "summary_error"),
]


def _nz(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def metadata_map(df: DataFrame) -> Column:
    entries = []
    for col, key in METADATA_COLUMNS:
        if col not in df.columns:
            continue
        v = F.col(col)
        if col == "hotness_score":
            v = F.format_string("%.3f", v)
        entries.append(F.when(F.col(col).isNotNull(), F.struct(F.lit(key).alias("key"), v.cast("string").alias("value"))))
    if "summary" in df.columns:
        entries.append(F.when(_nz(F.col("summary")).isNotNull(),
                              F.struct(F.lit("summary").alias("key"), F.col("summary").alias("value"))))
    if "reading_reason" in df.columns:
        entries.append(F.when(_nz(F.col("reading_reason")).isNotNull(),
                              F.struct(F.lit("reading_reason").alias("key"), F.col("reading_reason").alias("value"))))
    base = F.col("metadata") if "metadata" in df.columns else None
    if not entries:
        return base if base is not None else F.lit(None).cast("map<string,string>")
    arr = F.filter(F.array(*entries), lambda e: e.isNotNull())
    if base is not None:
        # typed columns win over carried metadata with the same key
        carried = F.filter(F.map_entries(F.coalesce(base, F.create_map().cast("map<string,string>"))),
                           lambda e: ~F.array_contains(F.transform(arr, lambda a: a["key"]), e["key"]))
        arr = F.concat(carried, arr)
    return F.when(F.size(arr) > 0, F.map_from_entries(arr))


def item_struct(df: DataFrame, with_version: bool = True) -> Column:
    """The item as its JSON record: empty strings, empty lists and maps are
    omitted (null), times RFC3339, derived values under ``metadata``;
    ``normalized_url`` and ``id`` filled as the JSONL writer does."""
    cols = df.columns
    g = lambda c: F.col(c) if c in cols else F.lit(None).cast("string")
    n = F.when(F.coalesce(g("normalized_url"), F.lit("")) != "", g("normalized_url")).otherwise(normalize_url(g("url")))
    key = F.when(n != "", n).otherwise(F.coalesce(g("url"), F.lit("")))
    ident = F.when(F.coalesce(g("id"), F.lit("")) != "", g("id")).otherwise(key)
    cats = F.col("categories") if "categories" in cols else F.lit(None).cast("array<string>")
    fields = []
    if with_version:
        fields.append(F.lit(ITEM_JSONL_VERSION).alias("schema_version"))
    fields += [
        _nz(ident).alias("id"), _nz(g("url")).alias("url"), _nz(n).alias("normalized_url"),
        _nz(g("title")).alias("title"), _nz(g("description")).alias("description"),
        _nz(g("content")).alias("content"),
        (rfc3339(F.col("published_at")) if "published_at" in cols else F.lit(None).cast("string")).alias("published_at"),
        (rfc3339(F.col("updated_at")) if "updated_at" in cols else F.lit(None).cast("string")).alias("updated_at"),
        _nz(g("source")).alias("source"),
        F.when(F.size(cats) > 0, cats).alias("categories"),
        metadata_map(df).alias("metadata"),
        _nz(g("summary")).alias("summary"), _nz(g("reading_reason")).alias("reading_reason"),
        _nz(g("bookmark_count")).alias("hatena_bookmark_count"),
    ]
    if "comments" in cols:
        fields.append(F.when(F.size("comments") > 0, F.col("comments")).alias("hatena_bookmark_comments"))
    return F.struct(*fields)


def jsonl_records(df: DataFrame) -> DataFrame:
    """(pos, line): one JSON Lines record per item (nulls omitted)."""
    return df.select("pos", F.to_json(item_struct(df)).alias("line"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", ordered: bool = True) -> None:
    recs = jsonl_records(df)
    if ordered:
        recs = recs.orderBy("pos")
    recs.select("line").write.mode(mode).text(path)


def json_array_lines(df: DataFrame) -> DataFrame:
    """Document rows of a JSON array of items (no version field)."""
    spark = df.sparkSession
    first = df.select(F.min("pos")).scalar()
    body = df.select("pos", F.to_json(item_struct(df, with_version=False)).alias("j"))
    rows = D.lines(body, F.concat(F.when(F.col("pos") == first, F.lit("  ")).otherwise(F.lit(", ")), F.col("j")),
                   1, F.col("pos"), 0)
    return D.header(spark, "[", k1=0).unionByName(rows).unionByName(D.header(spark, "]", k1=2))


def explain_records(ex: DataFrame) -> DataFrame:
    """(pos, line): explain JSON Lines records."""
    item_cols = ex.select("item.*").columns
    flat = ex.select(F.col("pos").alias("_x_pos"), F.col("output").alias("_x_output"),
                     F.col("kept").alias("_x_kept"), F.col("reasons").alias("_x_reasons"),
                     F.col("stages").alias("_x_stages"), "item.*")
    rec = F.struct(
        F.lit(EXPLAIN_JSONL_VERSION).alias("schema_version"), F.col("_x_output").alias("output"),
        F.col("_x_kept").alias("kept"),
        F.when(F.size("_x_reasons") > 0, F.col("_x_reasons")).alias("reasons"),
        F.when(F.size("_x_stages") > 0, F.transform("_x_stages", lambda s: F.struct(
            s["stage"].alias("stage"), s["kept"].alias("kept"),
            F.when(F.size(s["reasons"]) > 0, s["reasons"]).alias("reasons")))).alias("stages"),
        item_struct(flat.select(*item_cols), with_version=False).alias("item"))
    return flat.select(F.col("_x_pos").alias("pos"), F.to_json(rec).alias("line"))
