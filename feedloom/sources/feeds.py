"""Concatenated RSS/Atom text -> feed documents -> items.

``read_feed_text`` splits every file after each ``</rss>`` or ``</feed>``
(the tail without a closing tag is one last chunk); ``parse_feeds`` parses
each chunk with ``from_xml`` using one schema that holds RSS 2.0
(``channel.item[]``), Atom (``entry[]``) and RSS 1.0 (top-level
``item[]``); ``feed_items`` flattens documents to the items table.

Files are read with ``wholetext`` (one row per file): many medium files
scale out, one huge file is one task -- pre-chunk such inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NON_WS
from ..functions.times import parse_feed_time
from ..functions.urls import with_key
from ..operators.items import order_value

# Split points and the strict printable rule.
SPLIT_AFTER = r"(?<=</rss>)|(?<=</feed>)"
SPLIT_AFTER_WITH_RDF = r"(?<=</rss>)|(?<=</feed>)|(?<=</rdf:RDF>)"
NON_PRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]"
XML_ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"
FEED_ROOT = r"<(rss|feed|rdf:RDF)[\s>]"

S = T.StringType()


def _st(**kw) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kw.items()])


RSS_ITEM = _st(title=S, link=S, guid=S, description=S, **{"content:encoded": S}, pubDate=S,
               category=T.ArrayType(S), author=S, **{"dc:creator": S, "dc:date": S, "dc:subject": S})
ATOM_ENTRY = _st(title=S, link=T.ArrayType(_st(_href=S, _rel=S)), id=S, updated=S, published=S,
                 summary=S, content=S, author=_st(name=S), category=T.ArrayType(_st(_term=S)))
FEED_SCHEMA = T.StructType([
    T.StructField("channel", _st(title=S, link=S, description=S, item=T.ArrayType(RSS_ITEM))),
    T.StructField("title", S),
    T.StructField("entry", T.ArrayType(ATOM_ENTRY)),
    T.StructField("item", T.ArrayType(RSS_ITEM)),
    T.StructField("_corrupt_record", S),
])


def split_chunks(text: Column, rdf_split: bool = False) -> Column:
    """Array of chunks, each ending at a closing feed tag (tail kept)."""
    parts = F.split(text, SPLIT_AFTER_WITH_RDF if rdf_split else SPLIT_AFTER)
    return F.filter(parts, lambda p: p != "")


def clean_chunk(c: Column, strict_printable: bool = False) -> Column:
    """Default: drop XML-illegal control characters.  ``strict_printable``
    drops every non-printable rune, newlines and tabs included."""
    return F.regexp_replace(c, NON_PRINTABLE if strict_printable else XML_ILLEGAL, "")


def read_feed_text(spark: SparkSession, path, strict_printable: bool = False,
                   rdf_split: bool = False, source_ord: int = 0) -> DataFrame:
    """Chunks of concatenated feed files: (source, chunk_idx, chunk)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return chunk_text(_with_ordinal(raw, "file"), "value", strict_printable, rdf_split, source_ord)


def _with_ordinal(df: DataFrame, name_col: str) -> DataFrame:
    """Add ``_f``: the 0-based rank of ``name_col`` among distinct names.

    The distinct names (one short row per file or feed) are sorted by ranges and
    numbered from the counts of the ranges; the ordinals are joined back by name."""
    from ..operators.rank import with_rank
    ords = with_rank(df.select(name_col).distinct(), [F.col(name_col).asc()], "_n")
    return df.join(ords.select(name_col, (F.col("_n") - 1).alias("_f")), name_col)


def chunk_text(df: DataFrame, col: str = "value", strict_printable: bool = False,
               rdf_split: bool = False, source_ord: int = 0) -> DataFrame:
    """Split a text column (one stream per row) into chunks."""
    fcol = F.col("_f") if "_f" in df.columns else F.lit(0)
    return df.select((F.lit(source_ord) + fcol).cast("long").alias("source"),
                     F.posexplode(split_chunks(F.col(col), rdf_split)).alias("chunk_idx", "chunk")) \
        .withColumn("chunk", clean_chunk(F.col("chunk"), strict_printable))


def parse_feeds(chunks: DataFrame) -> DataFrame:
    """Parse chunks: (source, chunk_idx, blank, valid, error, title, doc)."""
    # whitespace left over from the previous document precedes the XML
    # declaration; the parser only accepts the declaration at the start
    body = F.regexp_replace(F.col("chunk"), r"^\s+", "")
    doc = F.from_xml(body, FEED_SCHEMA,
                     {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    p = chunks.withColumn("doc", doc)
    blank = ~F.col("chunk").rlike(NON_WS)
    rooted = F.col("chunk").rlike(FEED_ROOT)
    corrupt = F.col("doc._corrupt_record").isNotNull()
    error = (F.when(blank, F.lit("EOF"))
             .when(corrupt, F.lit("XML syntax error"))
             .when(~rooted, F.lit("Failed to detect feed type")))
    title = F.coalesce(F.col("doc.channel.title"), F.col("doc.title"), F.lit(""))
    extra = [c for c in chunks.columns if c not in ("source", "chunk_idx", "chunk")]
    return p.select("source", "chunk_idx", blank.alias("blank"), error.isNull().alias("valid"),
                    error.alias("error"), title.alias("feed_title"), "doc", *extra)


def _rss_item(i: Column, idx: Column, title: Column) -> Column:
    return F.struct(
        idx.alias("item_idx"), i["guid"].alias("id"), i["link"].alias("url"), i["title"].alias("title"),
        i["description"].alias("description"), i["content:encoded"].alias("content"),
        F.coalesce(i["pubDate"], i["dc:date"]).alias("published_raw"), F.lit(None).cast("string").alias("updated_raw"),
        F.coalesce(i["category"], F.when(i["dc:subject"].isNotNull(), F.array(i["dc:subject"]))).alias("categories"),
        F.coalesce(i["author"], i["dc:creator"]).alias("author"), title.alias("source"))


def _atom_item(e: Column, idx: Column, title: Column) -> Column:
    links = F.coalesce(e["link"], F.array().cast("array<struct<_href:string,_rel:string>>"))
    alt = F.filter(links, lambda l: l["_rel"].isNull() | (l["_rel"] == "alternate"))
    href = F.coalesce(F.try_element_at(alt, F.lit(1))["_href"], F.try_element_at(links, F.lit(1))["_href"])
    return F.struct(
        idx.alias("item_idx"), e["id"].alias("id"), href.alias("url"), e["title"].alias("title"),
        e["summary"].alias("description"), e["content"].alias("content"),
        e["published"].alias("published_raw"), e["updated"].alias("updated_raw"),
        F.transform(e["category"], lambda c: c["_term"]).alias("categories"),
        e["author"]["name"].alias("author"), title.alias("source"))


def feed_items(docs: DataFrame) -> DataFrame:
    """Flatten valid documents into the items table (feed title = source)."""
    v = docs.filter(F.col("valid"))
    title = F.col("feed_title")
    arr = F.coalesce(
        F.transform(F.col("doc.channel.item"), lambda i, k: _rss_item(i, k, title)),
        F.transform(F.col("doc.entry"), lambda e, k: _atom_item(e, k, title)),
        F.transform(F.col("doc.item"), lambda i, k: _rss_item(i, k, title)))
    x = v.select("source", "chunk_idx", F.explode(arr).alias("it")).filter(F.col("it").isNotNull())
    it = lambda n: F.coalesce(F.col("it." + n), F.lit(""))
    # dedup key of the link (normalize, else the link), staged projections
    x = with_key(x.withColumn("url", it("url")), "_key", normalized_col="_none_", url_col="url")
    key = F.col("_key")
    pos = order_value(F.col("source"), F.col("chunk_idx"), F.col("it.item_idx"))
    return x.select(
        pos.alias("pos"),
        F.when(it("id") != "", it("id")).otherwise(key).alias("id"),
        F.col("url"), key.alias("normalized_url"),
        it("title").alias("title"), it("description").alias("description"), it("content").alias("content"),
        parse_feed_time(F.col("it.published_raw")).alias("published_at"),
        parse_feed_time(F.col("it.updated_raw")).alias("updated_at"),
        it("published_raw").alias("published_raw"), it("updated_raw").alias("updated_raw"),
        it("author").alias("author"), it("source").alias("source"),
        F.coalesce(F.col("it.categories"), F.array().cast("array<string>")).alias("categories"),
        F.lit("").alias("summary"), F.lit("").alias("reading_reason"), F.lit("").alias("bookmark_count"))


def read_feeds(spark: SparkSession, path, **kw) -> DataFrame:
    """Items of every valid document in concatenated feed files."""
    return feed_items(parse_feeds(read_feed_text(spark, path, **kw)))


def feed_bodies_items(bodies: DataFrame, strict_printable: bool = False, strict: bool = False) -> DataFrame:
    """Items from a captured ``feed_bodies(feed_url, body)`` table (feed URL
    source re-aimed): feeds keep the table order of ``feed_url``.  A feed
    that was not captured (null body) is skipped, or with ``strict`` fails
    the job naming the feed, as a failed fetch aborts the reference run."""
    body = F.col("body")
    if strict:
        body = F.when(body.isNull(), F.raise_error(F.concat(
            F.lit("feed fetch failed ("), F.col("feed_url"), F.lit("): empty feed")))).otherwise(body)
    b = _with_ordinal(bodies, "feed_url").withColumn("value", F.coalesce(body.cast("string"), F.lit("")))
    return feed_items(parse_feeds(chunk_text(b, "value", strict_printable)))
