"""Registered queries: one per operator, each over the whole stored tables.

Every entry is ``fn(spark, sf_dir) -> DataFrame``; :data:`ORACLE` holds the
equivalent DuckDB SQL where SQL can say it.  Output columns are scalar and
aliased identically on both sides.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session as _session
from ..functions.times import ts_lit
from ..functions.urls import item_domain
from ..operators import dedup, enrich, filters, rank
from ..operators.items import key_col, normalize_items
from ..sources import tables
from . import oracle_sql as S

NOW = tables.VIEW_NOW
# Parameters of the registered queries (fixed so both sides agree).
KEYWORD_INCLUDE = ["the", "ción", "und"]
KEYWORD_EXCLUDE = ["license", "password"]
KEYWORD_MIN_SCORE = 2
DOMAIN_INCLUDE = ["example.com", "example.org"]
DOMAIN_EXCLUDE = ["spam-farm.example.org", "cheap-pills.example.com"]
WINDOW = "240h"
MIN_HOTNESS = 77.0
FAV_USERS = ["U7", "u42", " u99 ", "u120"]
NEW_SNAPSHOT_FROM = _dt.datetime(2024, 1, 21)
ARCHIVE_UNTIL = _dt.datetime(2024, 1, 25)
DEFAULT_SOURCE = "unlabeled"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _fmt_ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _items(spark, sf_dir) -> DataFrame:
    _session.prepare(spark)
    return tables.items_view(spark, sf_dir)


def _enriched(spark, sf_dir) -> DataFrame:
    items = _items(spark, sf_dir)
    return enrich.bookmark_enrich(items, tables.bookmark_counts_view(spark, sf_dir),
                                  tables.comments_view(spark, sf_dir))


def _bare_items(spark, sf_dir) -> DataFrame:
    """Link-only items (title/description/source empty), one per page, after
    all view items in input order."""
    items = _items(spark, sf_dir)
    return items.select(
        (F.col("pos") + F.lit(1 << 40)).alias("pos"), *[
            (F.lit("") if c in ("title", "description", "source") else F.col(c)).alias(c)
            for c in items.columns if c != "pos"])


# ---------------------------------------------------------------- scalars ---

@register("normalize_url", S.with_(S.ITEMS_CTE) + f"""
select pos, url, nkey as normalized_url, {S.domain('nkey')} as domain, nkey as id from items""")
def q_normalize_url(spark, sf_dir):
    items = normalize_items(_items(spark, sf_dir))
    return items.select("pos", "url", "normalized_url",
                        item_domain(F.col("normalized_url")).alias("domain"), "id")


# ------------------------------------------------------------- set ops ------

@register("merge_items", S.with_(S.ITEMS_CTE, S.VARIANTS_CTE) + """
select pos, url, title, nkey as dedup_key from (
  select *, row_number() over (partition by nkey order by pos) as rn from variants) where rn = 1""")
def q_merge_items(spark, sf_dir):
    m = dedup.merge_items(tables.item_variants_view(spark, sf_dir))
    return m.select("pos", "url", "title", key_col(m).alias("dedup_key"))


@register("diff_items", S.with_(S.ITEMS_CTE, S.VARIANTS_CTE) + f"""
select v.pos, v.url, v.nkey as dedup_key from variants v
where not exists (select 1 from items n where n.published_at >= timestamp '2024-01-21 00:00:00'
                  and n.nkey <> '' and n.nkey = v.nkey)""")
def q_diff_items(spark, sf_dir):
    old = tables.item_variants_view(spark, sf_dir)
    new = _items(spark, sf_dir).filter(F.col("published_at") >= ts_lit(NEW_SNAPSHOT_FROM))
    d = dedup.diff_items(old, new)
    return d.select("pos", "url", key_col(d).alias("dedup_key"))


@register("archive_upsert", S.with_(S.ITEMS_CTE, S.VARIANTS_CTE) + f"""
, newi as (select pos, url, nkey from items where published_at >= timestamp '2024-01-21 00:00:00'),
old as (select pos, url, nkey from (
  select *, row_number() over (partition by nkey order by pos) rn from variants
  where published_at < timestamp '2024-01-25 00:00:00') where rn = 1)
select pos, url, nkey as dedup_key from newi
union all
select pos + {1 << 104}, url, nkey from old o where not exists (select 1 from newi n where n.nkey = o.nkey)""")
def q_archive_upsert(spark, sf_dir):
    new = _items(spark, sf_dir).filter(F.col("published_at") >= ts_lit(NEW_SNAPSHOT_FROM))
    archived = tables.item_variants_view(spark, sf_dir).filter(F.col("published_at") < ts_lit(ARCHIVE_UNTIL))
    u = dedup.archive_upsert(new, archived)
    return u.select("pos", "url", key_col(u).alias("dedup_key"))


# ------------------------------------------------------------- filters ------

def _kw_text_sql():
    return "lower(title || ' ' || description || ' ' || '' || ' ' || lang)"


def _kw_sql():
    t = _kw_text_sql()
    score = " + ".join(f"cast(contains({t}, {S.q(p)}) as integer)" for p in KEYWORD_INCLUDE)
    excl = " or ".join(f"contains({t}, {S.q(p)})" for p in KEYWORD_EXCLUDE)
    return S.with_(S.ITEMS_CTE) + f"""
select pos, url, keyword_score from (select pos, url, ({score}) as keyword_score, ({excl}) as excluded from items)
where not excluded and keyword_score > 0 and keyword_score >= {KEYWORD_MIN_SCORE}"""


@register("keyword_filter", _kw_sql())
def q_keyword_filter(spark, sf_dir):
    k = filters.keyword_filter(_items(spark, sf_dir), KEYWORD_INCLUDE, KEYWORD_EXCLUDE, KEYWORD_MIN_SCORE)
    return k.select("pos", "url", "keyword_score")


def _dom_sql():
    d = S.domain("nkey")
    m = lambda pats: " or ".join(f"(dom = {S.q(p)} or ends_with(dom, {S.q('.' + p)}))" for p in pats)  # noqa
    return S.with_(S.ITEMS_CTE) + f"""
select pos, url, dom as domain from (select pos, url, {d} as dom from items)
where dom <> '' and not ({m(DOMAIN_EXCLUDE)}) and ({m(DOMAIN_INCLUDE)})"""


@register("domain_filter", _dom_sql())
def q_domain_filter(spark, sf_dir):
    d = filters.domain_filter(_items(spark, sf_dir), DOMAIN_INCLUDE, DOMAIN_EXCLUDE)
    return d.select("pos", "url", "domain")


@register("time_window", S.with_(S.ITEMS_CTE) + f"""
select pos, url, strftime(published_at, '%Y-%m-%d %H:%M:%S') as published from items
where published_at >= {S.NOW} - interval 240 hour""")
def q_time_window(spark, sf_dir):
    t = filters.time_window(_items(spark, sf_dir), WINDOW, NOW)
    return t.select("pos", "url", _fmt_ts(F.col("published_at")).alias("published"))


def _hot_sql_body():
    return S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + f"""
, hot as (
  select i.pos, i.url, coalesce(cast(b.n as varchar), '') as bookmark_count,
    coalesce(c.n, 0) as comment_count,
    {S.hotness('coalesce(b.n, 0)', 'coalesce(c.n, 0)', 'i.published_at')} as hotness_score,
    i.published_at
  from items i left join bcounts b on b.url = i.url left join ccounts c on c.url = i.url)
"""


@register("bookmark_enrich", S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + """
select i.pos, i.url, coalesce(cast(b.n as varchar), '') as bookmark_count, coalesce(c.n, 0) as comment_count
from items i left join bcounts b on b.url = i.url left join ccounts c on c.url = i.url""")
def q_bookmark_enrich(spark, sf_dir):
    return _enriched(spark, sf_dir).select("pos", "url", "bookmark_count", "comment_count")


@register("hotness_score", _hot_sql_body() + """
select pos, url, bookmark_count, comment_count, hotness_score from hot""")
def q_hotness_score(spark, sf_dir):
    h = rank.hotness_score(_enriched(spark, sf_dir), NOW)
    return h.select("pos", "url", "bookmark_count", "comment_count", "hotness_score")


@register("min_hotness", _hot_sql_body() + f"""
select pos, url, hotness_score from hot where hotness_score >= {MIN_HOTNESS}""")
def q_min_hotness(spark, sf_dir):
    h = filters.min_hotness(rank.hotness_score(_enriched(spark, sf_dir), NOW), MIN_HOTNESS)
    return h.select("pos", "url", "hotness_score")


@register("rank_hotness", _hot_sql_body() + """
select pos, url, hotness_score, row_number() over (order by hotness_score desc, pos) as rank from hot""")
def q_rank_hotness(spark, sf_dir):
    h = rank.hotness_score(_enriched(spark, sf_dir), NOW).select("pos", "url", "hotness_score")
    return rank.with_rank(h, rank.rank_order(h, "hotness"))


@register("rank_published", S.with_(S.ITEMS_CTE) + """
select pos, url, strftime(published_at, '%Y-%m-%d %H:%M:%S') as published,
  row_number() over (order by published_at desc nulls last, pos) as rank from items""")
def q_rank_published(spark, sf_dir):
    i = _items(spark, sf_dir).select("pos", "url", "published_at")
    r = rank.with_rank(i, rank.rank_order(i, "published"))
    return r.select("pos", "url", _fmt_ts(F.col("published_at")).alias("published"), "rank")


def _fav_sql():
    watch = ", ".join(S.q(u.strip().lower()) for u in FAV_USERS if u.strip())
    return S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + f"""
, m as (select url, lower("user") as lu, min(ord) as first_ord, arg_min("user", ord) as u
        from comments where lower("user") in ({watch}) group by url, lower("user")),
f as (select url, string_agg(u, ',' order by first_ord) as fav_users from m group by url)
select i.pos, i.url, f.fav_users from items i join f on f.url = i.url"""


@register("fav_user", _fav_sql())
def q_fav_user(spark, sf_dir):
    f = filters.fav_user(_items(spark, sf_dir), tables.comments_view(spark, sf_dir), FAV_USERS)
    return f.select("pos", "url", "fav_users")


# ------------------------------------------------------------- enrichers ----

@register("source_label", S.with_(S.ITEMS_CTE) + f"""
select pos, url, source, source as source_label from items where trim(source) <> ''
union all
select pos + {1 << 40}, url, {S.q(DEFAULT_SOURCE)}, {S.q(DEFAULT_SOURCE)} from items""")
def q_source_label(spark, sf_dir):
    both = _items(spark, sf_dir).unionByName(_bare_items(spark, sf_dir))
    s = enrich.source_label(both, DEFAULT_SOURCE)
    return s.select("pos", "url", "source", "source_label")


@register("tag_enrich", S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + """
, t as (select url, tag, min(ord) as o from comments group by url, tag),
tl as (select url, string_agg(tag, ',' order by o) as tags from t group by url)
select i.pos, i.url, concat_ws(',', nullif(i.lang, ''), tl.tags) as categories
from items i left join tl on tl.url = i.url""")
def q_tag_enrich(spark, sf_dir):
    t = enrich.tag_enrich(_items(spark, sf_dir), tables.comments_view(spark, sf_dir))
    return t.select("pos", "url", F.array_join("categories", ",").alias("categories"))


def _summary_sql():
    fne = f"coalesce(nullif({S.go_trim('i.description')}, ''), nullif({S.go_trim('i.title')}, ''), '')"
    cl = S.clean(fne)
    return S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + f"""
select i.pos, (case when length({cl}) <= 160 then {cl} else left({cl}, 157) || '...' end) as summary,
  case when b.n is not null and cast(b.n as varchar) <> '0' then 'Hatena Bookmark: ' || cast(b.n as varchar)
       when i.source <> '' then 'source: ' || i.source else 'source feed item' end as reading_reason
from items i left join bcounts b on b.url = i.url"""


@register("summarize", _summary_sql())
def q_summarize(spark, sf_dir):
    s = enrich.summarize(_enriched(spark, sf_dir))
    return s.select("pos", "summary", "reading_reason")


def _ogp_sql():
    return S.with_(S.ITEMS_CTE) + f"""
, both_ as (select pos, url, title, description from items
            union all select pos + {1 << 40}, url, '', '' from items),
meta as (select url, {S.page_title('html')} as page_title from pages)
select b.pos, b.url,
  case when b.title = '' then coalesce(nullif(m.page_title, ''), '') else b.title end as title,
  b.description, nullif(m.page_title, '') as page_title,
  case when m.url is null then 'page not captured' end as ogp_error
from both_ b left join meta m on m.url = b.url"""


@register("ogp_enrich", _ogp_sql())
def q_ogp_enrich(spark, sf_dir):
    both = _items(spark, sf_dir).unionByName(_bare_items(spark, sf_dir))
    o = enrich.ogp_enrich(both, tables.page_snapshots_view(spark, sf_dir))
    return o.select("pos", "url", "title", "description", "page_title", "ogp_error")


def _content_sql():
    doc, text = S.readable_text("html")
    return S.with_(S.ITEMS_CTE) + f"""
, txt as (select d.url, {text} as content from (select url, {doc} as doc from pages) d)
select i.pos, i.url, case when t.url is null then '' else t.content end as content, t.content as content_text from items i left join txt t on t.url = i.url"""


@register("content_enrich", _content_sql())
def q_content_enrich(spark, sf_dir):
    c = enrich.content_enrich(_items(spark, sf_dir), tables.page_snapshots_view(spark, sf_dir))
    return c.select("pos", "url", "content", "content_text")


_META_TAGS = ("<meta content=\"say name='og:title' &amp; more\" property=og:title><META NAME='Description' CONTENT=' plain "
              "&eacute; '><meta property=\"og:site_name\" content=\"Site &#8212; ")


def _page_meta_sql():
    return """
select url, 'say name=''og:title'' & more' as og_title, '' as og_description, 'https://img.example.com/' || cast(page_id as varchar) as og_image,
  'Site — ' || cast(page_id as varchar) as og_site_name, 'plain é' as meta_description from pages"""


@register("page_meta", _page_meta_sql())
def q_page_meta(spark, sf_dir):
    """Metadata of every page, with meta tags added behind its head tag."""
    _session.prepare(spark)
    pages = tables.read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    extra = F.concat(F.lit("<head>" + _META_TAGS), F.col("page_id").cast("string"), F.lit('"><meta property="og:image" content="https://img.example.com/'),
                     F.col("page_id").cast("string"), F.lit('"><meta property="og:description" content="">'))
    html = F.concat(F.split_part("html", F.lit("<head>"), F.lit(1)), extra,
                    F.substring("html", F.instr("html", "<head>") + 6, F.length("html")))
    m = enrich.page_meta(pages.select("url", F.lit(200).alias("status"), html.alias("html")))
    return m.select("url", "og_title", "og_description", "og_image", "og_site_name", "meta_description")


_REFERENCES = [("a ", "&agrave; ", "à "), ("e ", "&#233; ", "é "), ("o ", "&#x2014; ", "— "), ("n ", "&hellip; ", "… "),
               ("s ", "&copy ", "© "), ("d ", "&amp;lt; ", "&lt; ")]


def _html_entities_sql():
    plain = "coalesce(text, '')"
    for find, _, char in _REFERENCES:
        plain = f"replace({plain}, {S.q(find)}, {S.q(char)})"
    cl = S.clean(plain)
    return f"""select doc_id, case when length({cl}) <= 180 then {cl} else left({cl}, 180) || '...' end as summary,
  sha256({cl}) as whole from documents"""


@register("html_entities", _html_entities_sql())
def q_html_entities(spark, sf_dir):
    """Digest summaries of texts that hold named, old and numeric references."""
    from ..functions.text import clean_text, html_unescape
    from ..sinks.digest import digest_summary
    _session.prepare(spark)
    text = F.col("text")
    docs = tables.read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for i, (find, _, _) in enumerate(_REFERENCES):  # marks first, so that no reference is cut by the next one
        docs = docs.withColumn("text", F.replace("text", F.lit(find), F.lit(chr(0xE000 + i))))
    for i, (_, reference, _) in enumerate(_REFERENCES):
        docs = docs.withColumn("text", F.replace("text", F.lit(chr(0xE000 + i)), F.lit(reference)))
    # a column of its own, as Spark would decode the text once for each use in one select
    docs = docs.select("doc_id", clean_text(html_unescape(text)).alias("plain"))
    return docs.select("doc_id", digest_summary(F.col("plain"), plain=True).alias("summary"), F.sha2("plain", 256).alias("whole"))


# ------------------------------------------------------------- flagship -----

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalize -> merge (items + tracking variants) -> keyword filter ->
    bookmark/comment join -> hotness -> rank by hotness."""
    _session.prepare(spark)
    items = normalize_items(tables.item_variants_view(spark, sf_dir))
    merged = dedup.merge_items(items)
    kept = filters.keyword_filter(merged, KEYWORD_INCLUDE, KEYWORD_EXCLUDE, 1)
    enriched = enrich.bookmark_enrich(kept, tables.bookmark_counts_view(spark, sf_dir),
                                      tables.comments_view(spark, sf_dir))
    hot = rank.hotness_score(enriched, NOW)
    return rank.rank(hot, "hotness").select(
        "pos", "url", "normalized_url", "title", "keyword_score", "bookmark_count",
        "comment_count", "hotness_score")


# ------------------------------------------------------- comment delta ------

from ..operators import delta as _delta  # noqa: E402

_DELTA_CTE = S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + r"""
, e0 as (select pos, url, title, description,
          case when nkey <> '' then nkey else url end as entry_key, published_at from items),
prior as (
  select case when e.entry_key = e.url then e.entry_key else e.url end as entry_key,
    coalesce(strftime(max(date_trunc('minute', c.ts)) filter (where date_trunc('minute', c.ts) < timestamp '2024-01-20 00:00:00'),
                      '%Y-%m-%dT%H:%M:%SZ'), '1970-01-01T00:00:00Z') as last_comment_timestamp,
    'T' || cast(e.pos as varchar) as thread_id
  from e0 e left join comments c on c.url = e.url
  where e.published_at < timestamp '2024-01-20 00:00:00'
  group by e.pos, e.url, e.entry_key),
first as (select * from (select *, row_number() over (partition by entry_key order by pos) rn from e0) where rn = 1),
ent as (
  select f.entry_key, f.pos, f.url, f.title, f.description,
    s1.entry_key is not null as by_key,
    s1.entry_key is null and f.url <> f.entry_key and s2.entry_key is not null as by_url,
    case when s1.entry_key is not null then s1.last_comment_timestamp
         when f.url <> f.entry_key and s2.entry_key is not null then s2.last_comment_timestamp
         else '1970-01-01T00:00:00Z' end as last_txt,
    case when s1.entry_key is not null then s1.thread_id
         when f.url <> f.entry_key and s2.entry_key is not null then s2.thread_id
         else sha256('6:parent' || length(f.entry_key) || ':' || f.entry_key) end as thread_id
  from first f left join prior s1 on s1.entry_key = f.entry_key left join prior s2 on s2.entry_key = f.url),
links as (select distinct url, entry_key from e0),
newc as (
  select n.entry_key, n.thread_id, c."user", c.comment, c.ts_text, c.ord,
    strptime(c.ts_text, '%Y/%m/%d %H:%M') as ct
  from comments c join links l on l.url = c.url join ent n on n.entry_key = l.entry_key
  where strptime(c.ts_text, '%Y/%m/%d %H:%M') > strptime(n.last_txt, '%Y-%m-%dT%H:%M:%SZ')),
plan as (
  select n.entry_key, n.url, not (n.by_key or n.by_url) as parent_post,
    coalesce(k.cnt, 0) as new_comments, k.mx, n.last_txt, n.thread_id, n.by_url
  from ent n left join (select entry_key, count(*) as cnt, max(ct) as mx from newc group by entry_key) k
    on k.entry_key = n.entry_key)
"""


def _delta_result(spark, sf_dir):
    items = _items(spark, sf_dir)
    return _delta.comment_delta(items, tables.comments_view(spark, sf_dir),
                                tables.prior_state_view(spark, sf_dir))


@register("comment_delta", _DELTA_CTE + """
select 'parent' as kind, entry_key, thread_id, null as "user", null as comment_time,
  description as text, thread_id as message_id
from ent where not (by_key or by_url)
union all
select 'comment', entry_key, thread_id, "user", strftime(ct, '%Y-%m-%dT%H:%M:%SZ'),
  '*' || "user" || '* さん: ' || comment, sha256(length(entry_key) || ':' || entry_key || length("user") || ':' || "user" || length(ts_text) || ':' || ts_text || length(comment) || ':' || comment)
from newc""")
def q_comment_delta(spark, sf_dir):
    r = _delta_result(spark, sf_dir)
    return r.outbox.select("kind", "entry_key", "thread_id", "user", "comment_time", "text", "message_id")


@register("comment_delta_plan", _DELTA_CTE + """
select entry_key, url, parent_post, new_comments from plan""")
def q_comment_delta_plan(spark, sf_dir):
    return _delta_result(spark, sf_dir).plan.select("entry_key", "url", "parent_post", "new_comments")


@register("plan_totals", _DELTA_CTE + """
select cast(sum(cast(parent_post as bigint)) as bigint) as parent_posts,
  cast(coalesce(sum(new_comments), 0) as bigint) as comment_posts from plan""")
def q_plan_totals(spark, sf_dir):
    return _delta.plan_totals(_delta_result(spark, sf_dir).plan)


def _reported(outbox: DataFrame) -> DataFrame:
    """Stand-in for a delivery report: parents of spam links are missing, comments with "cart" failed."""
    parent = F.col("kind") == "parent"
    return outbox.filter(~parent | ~F.contains("entry_key", F.lit("spam"))).select(
        "message_id", F.when(parent, F.lit(True)).otherwise(~F.contains("text", F.lit("cart"))).alias("ok")).distinct()


@register("delivery_totals", _DELTA_CTE + """
, sent as (select 'parent' as kind, not contains(entry_key, 'spam') as ok from ent where not (by_key or by_url)
  union all select 'comment', not contains(comment, 'cart') from newc)
select count(*) filter (where ok and kind = 'parent') as parents_sent, count(*) filter (where ok and kind = 'comment') as comments_sent,
  count(*) filter (where not ok) as failed, count(*) filter (where not ok) > 0 as job_failed from sent""")
def q_delivery_totals(spark, sf_dir):
    """Totals of a delivery in which some messages failed or were not reported."""
    outbox = _delta_result(spark, sf_dir).outbox
    return _delta.delivery_totals(outbox, _reported(outbox))


@register("state_after_delivery", _DELTA_CTE + """
, cm as (select entry_key, ct, not contains("user" || comment, 'cart') as ok from newc),
failed as (select entry_key, min(ct) as ct from cm where not ok group by entry_key),
sent as (select cm.entry_key, max(cm.ct) as mx from cm left join failed f on f.entry_key = cm.entry_key
  where ok and (f.ct is null or cm.ct < f.ct) group by cm.entry_key)
select n.entry_key,
  case when mx > strptime(last_txt, '%Y-%m-%dT%H:%M:%SZ') then strftime(mx, '%Y-%m-%dT%H:%M:%SZ') else last_txt end as last_comment_timestamp,
  thread_id
from ent n left join sent s on s.entry_key = n.entry_key where by_key or by_url or not contains(n.entry_key, 'spam')
union all
select p.entry_key, p.last_comment_timestamp, p.thread_id from prior p
where not exists (select 1 from ent n where n.entry_key = p.entry_key)
  and not exists (select 1 from ent n where n.by_url and n.url = p.entry_key)""")
def q_state_after_delivery(spark, sf_dir):
    """State after a delivery in which some parents were not reported and some
    comments failed: what comes after an entry's first failure is offered again."""
    result = _delta_result(spark, sf_dir)
    return _delta.state_after_delivery(tables.prior_state_view(spark, sf_dir), result, _reported(result.outbox))


@register("comment_delta_state", _DELTA_CTE + """
select entry_key,
  case when mx is not null and mx > strptime(last_txt, '%Y-%m-%dT%H:%M:%SZ')
       then strftime(mx, '%Y-%m-%dT%H:%M:%SZ') else last_txt end as last_comment_timestamp,
  thread_id
from plan
union all
select p.entry_key, p.last_comment_timestamp, p.thread_id from prior p
where not exists (select 1 from ent n where n.entry_key = p.entry_key)
  and not exists (select 1 from ent n where n.by_url and n.url = p.entry_key)""")
def q_comment_delta_state(spark, sf_dir):
    return _delta_result(spark, sf_dir).new_state


# -------------------------------------------------------------- explain -----

from ..operators.explain import explain_items as _explain_items  # noqa: E402
from . import stages as _stages  # noqa: E402

EXPLAIN_INCLUDE = ["the", "und"]
EXPLAIN_EXCLUDE = ["license"]
EXPLAIN_MIN_HOTNESS = 2.0


def _explain_stage_list():
    return [_stages.NormalizeStage(), _stages.MergeStage(),
            *_stages.filter_rank_stages(include=EXPLAIN_INCLUDE, exclude=EXPLAIN_EXCLUDE,
                                        exclude_domain=DOMAIN_EXCLUDE, since=WINDOW,
                                        rank_by="hotness", min_hotness=EXPLAIN_MIN_HOTNESS, now=NOW)]


def _explain_sql():
    t = _kw_text_sql()
    score = " + ".join(f"cast(contains({t}, {S.q(p)}) as integer)" for p in EXPLAIN_INCLUDE)
    hits = (f"array_to_string(list_filter([{', '.join(S.q(p) for p in EXPLAIN_EXCLUDE)}], "
            f"lambda p: contains({t}, p)), ',')")
    dm = " or ".join(f"(dom = {S.q(p)} or ends_with(dom, {S.q('.' + p)}))" for p in DOMAIN_EXCLUDE)
    hot = S.hotness("0", "0", "published_at")
    return S.with_(S.ITEMS_CTE) + f"""
, m as (select *, row_number() over (partition by nkey order by pos) = 1 as mk,
          {S.domain('nkey')} as dom from items),
k as (select *, ({score}) as score, {hits} as hits, {hot} as hot from m),
f as (select *,
  mk and hits = '' and score > 0 as a2,
  mk and hits = '' and score > 0 and dom <> '' and not ({dm}) as a3x,
  published_at is not null and published_at >= {S.NOW} - interval 240 hour as tw
  from k),
g as (select *, coalesce(a3x, false) or (a2 and dom = '') as a3 from f),
h as (select *, a3 and tw as a4, a3 and tw and hot >= {EXPLAIN_MIN_HOTNESS} as a5 from g)
select pos, a5 as kept,
  array_to_string(list_filter([
    'normalize: set normalized_url/id',
    case when mk then 'merge: kept key=' || nkey else 'merge: dropped duplicate key=' || nkey end,
    case when mk and hits <> '' then 'keyword_filter: dropped by exclude=' || hits end,
    case when mk then case when score = 0 then 'keyword_filter: dropped by no include match'
                           else 'keyword_filter: score=' || cast(score as varchar) end end,
    case when a2 then case when dom <> '' and ({dm}) then 'domain_filter: dropped by exclude domain=' || dom
                           else 'domain_filter: domain=' || case when dom = '' then '(empty)' else dom end end end,
    case when a3 then case when published_at is null then 'time_window_filter: dropped by missing published time'
                           when not tw then 'time_window_filter: dropped by older than 240h0m0s'
                           else 'time_window_filter: within 240h0m0s' end end,
    case when a4 then 'hotness_score: score=' || printf('%.3f', hot) end,
    case when a4 then case when hot < {EXPLAIN_MIN_HOTNESS}
                           then 'min_hotness: dropped by min={EXPLAIN_MIN_HOTNESS:.3f} score=' || printf('%.3f', hot)
                           else 'min_hotness: score=' || printf('%.3f', hot) end end,
    case when a5 then 'rank: by=hotness' end], lambda x: x is not null), ' | ') as reasons,
  case when a5 then score end as keyword_score,
  case when a5 then hot end as hotness_score,
  case when a5 then dom end as domain
from h"""


@register("explain_items", _explain_sql())
def q_explain_items(spark, sf_dir):
    ex = _explain_items(_items(spark, sf_dir), _explain_stage_list(), _stages.Context(now=NOW))
    return ex.select("pos", "kept", F.array_join("reasons", " | ").alias("reasons"),
                     F.col("item.keyword_score").alias("keyword_score"),
                     F.col("item.hotness_score").alias("hotness_score"),
                     F.col("item.domain").alias("domain"))


# ------------------------------------------------- sources, sinks, chains ---

import uuid as _uuid  # noqa: E402

from ..operators import lint as _lint  # noqa: E402
from ..sinks import digest as _digest, feeds as _feeds, jsonl as _jsonl  # noqa: E402
from ..sources import feeds as _src_feeds, jsonl as _src_jsonl  # noqa: E402

DOC_SIZE = 20          # items per generated feed document
BAD_DOC_MARK = "spam-farm"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = _session.checkpoint_dir(spark).rstrip("/")
    return f"{base}/feedloom-work/{name}-{_uuid.uuid4().hex}"


def _feed_stream_dir(spark, sf_dir, stamp_now: bool = False) -> str:
    """Write the items as a concatenated RSS stream (one document per 20
    consecutive items; a document holding a spam-farm link is written with
    a broken root so that it fails to parse) and return its folder.  With
    ``stamp_now`` items without a time get the writer's "now", as the feed
    writer does."""
    items = _items(spark, sf_dir)
    if stamp_now:
        items = items.withColumn("published_at", F.coalesce(F.col("published_at"), ts_lit(NOW)))
    items = items.withColumn("_doc", F.floor(F.col("pos") / DOC_SIZE).cast("long"))
    items = items.withColumn("_title", F.concat(F.lit("feed "), F.col("_doc").cast("string")))
    bad = items.groupBy("_doc").agg(F.max(F.contains("url", F.lit(BAD_DOC_MARK)).cast("int")).alias("_bad"))
    lines = _feeds.feed_stream_lines(items, "_doc", "_title").join(
        bad.withColumnRenamed("_doc", "k1"), "k1")
    lines = lines.withColumn("line", F.when((F.col("_bad") == 1) & (F.col("k2") == 0),
                                            F.replace("line", F.lit('<rss version="2.0">'), F.lit("<html>")))
                             .otherwise(F.col("line"))).drop("_bad")
    path = work_dir(spark, "feeds")
    _feeds.write_feed_stream(lines, path)
    return path


_BAD_DOCS_CTE = f"""
, docs as (select pos // {DOC_SIZE} as doc, max(cast(contains(url, '{BAD_DOC_MARK}') as int)) as bad
           from items group by 1)"""


@register("feed_roundtrip", S.with_(S.ITEMS_CTE) + _BAD_DOCS_CTE + f"""
select i.url, case when i.nkey <> '' then i.nkey else i.url end as id, i.title,
  strftime(coalesce(i.published_at, {S.NOW}), '%Y-%m-%d %H:%M:%S') as published,
  'feed ' || cast(i.pos // {DOC_SIZE} as varchar) as source
from items i join docs d on d.doc = i.pos // {DOC_SIZE} where d.bad = 0""")
def q_feed_roundtrip(spark, sf_dir):
    path = _feed_stream_dir(spark, sf_dir, stamp_now=True)
    got = _src_feeds.read_feeds(spark, path)
    return got.select("url", "id", "title", _fmt_ts(F.col("published_at")).alias("published"), "source")


@register("lint_counts", S.with_(S.ITEMS_CTE) + _BAD_DOCS_CTE + """
select count(*) as total, count(*) filter (where bad = 0) as valid, count(*) filter (where bad = 1) as invalid,
  count(*) filter (where bad = 1) = 0 as ok from docs""")
def q_lint_counts(spark, sf_dir):
    path = _feed_stream_dir(spark, sf_dir)
    docs = _src_feeds.parse_feeds(_src_feeds.read_feed_text(spark, path))
    return _lint.lint(docs)


@register("jsonl_roundtrip", S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + """
select i.url, i.nkey as id, i.nkey as normalized_url, i.title, i.description,
  strftime(i.published_at, '%Y-%m-%d %H:%M:%S') as published, i.source,
  i.lang as categories, coalesce(cast(b.n as varchar), '') as bookmark_count
from items i left join bcounts b on b.url = i.url""")
def q_jsonl_roundtrip(spark, sf_dir):
    path = work_dir(spark, "jsonl")
    _jsonl.write_jsonl(_enriched(spark, sf_dir), path)
    got = _src_jsonl.read_items_jsonl(spark, path)
    return got.select("url", "id", "normalized_url", "title", "description",
                      _fmt_ts(F.col("published_at")).alias("published"), "source",
                      F.array_join("categories", ",").alias("categories"), "bookmark_count")


@register("jsonl_many_files", S.with_(S.ITEMS_CTE) + """
select i.url, i.nkey as dedup_key, case when contains(i.url, '?') then 'first' else 'second' end as won_by
from (select *, row_number() over (partition by nkey order by contains(url, '?') desc, pos) as rn from items) i
where rn = 1 and nkey <> ''""")
def q_jsonl_many_files(spark, sf_dir):
    """A small file of the items whose link has a query, then larger ones with
    every item once more; a key's winner is the row of the first file."""
    from ..operators.items import drop_null_rows
    path = work_dir(spark, "jsonl-many")
    items = _items(spark, sf_dir).withColumn("source", F.lit("second"))
    few = items.filter(F.contains("url", F.lit("?"))).withColumn("source", F.lit("first")).withColumn("description", F.lit(""))
    _jsonl.jsonl_records(few).orderBy("pos").select("line").write.text(f"{path}/a")
    _jsonl.jsonl_records(items).orderBy("pos").select("line").write.text(f"{path}/b")
    got = drop_null_rows(_src_jsonl.read_items_jsonl(spark, [f"{path}/a", f"{path}/b"]))
    m = dedup.merge_items(got.filter(F.col("normalized_url") != ""))
    return m.select("url", F.col("normalized_url").alias("dedup_key"), F.col("source").alias("won_by"))


@register("union_sources", S.with_(S.ITEMS_CTE) + f"""
, u as (select pos, 'view' as came, url, nkey from items
  union all select pos + {1 << 104}, 'again', url, nkey from items
  union all select pos + {1 << 105}, 'third', url, nkey from items where published_at is null)
select came, count(*) as n, count(distinct pos) as n_pos, min(pos)::VARCHAR as lo, max(pos)::VARCHAR as hi from u group by came""")
def q_union_sources(spark, sf_dir):
    """A union of a union and a third source: no two rows share a position."""
    from ..operators.items import union_ordered
    items = _items(spark, sf_dir)
    came = lambda df, name: df.withColumn("came", F.lit(name))
    two = union_ordered(came(items, "view"), came(items, "again"))
    three = union_ordered(two, came(items.filter(F.col("published_at").isNull()), "third"))
    return three.groupBy("came").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("n_pos"),
                                     F.min("pos").cast("string").alias("lo"), F.max("pos").cast("string").alias("hi"))


def _digest_sql():
    t = S.go_trim("i.title")
    label = f"(case when {t} = '' then i.url else {t} end)"
    label = f"replace(replace({label}, '[', '\\['), ']', '\\]')"
    summ = S.clean(S.go_trim(S.unescape("i.description")))
    summ = f"(case when length({summ}) <= 180 then {summ} else left({summ}, 180) || '...' end)"
    return S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + f"""
, w as (select i.*, coalesce(cast(b.n as varchar), '') as cnt from items i left join bcounts b on b.url = i.url
        where i.published_at >= {S.NOW} - interval 240 hour),
l as (
  select cast(0 as bigint) as k1, cast(0 as bigint) as k2, cast(0 as bigint) as k3, '# feedloom digest' as line
  union all select 0, 1, 0, ''
  union all select 0, 2, 0, 'Window: 2024-01-21T00:00:00Z - 2024-01-31T00:00:00Z'
  union all select 0, 3, 0, ''
  union all select 0, 4, 0, 'Items: ' || cast((select count(*) from w) as varchar)
  union all select 0, 5, 0, ''
  union all select 1, -epoch_us(i.published_at), i.pos * 2,
    '- [' || {label} || '](' || i.url || ') - ' || strftime(i.published_at, '%Y-%m-%dT%H:%M:%SZ')
    || case when i.cnt not in ('', '0') then ' - Hatena Bookmark: ' || i.cnt else '' end
  from w i
  union all select 1, -epoch_us(i.published_at), i.pos * 2 + 1, '  ' || {summ}
  from w i where {summ} <> '')
select * from l"""


@register("digest", _digest_sql())
def q_digest(spark, sf_dir):
    return _digest.digest_lines(_enriched(spark, sf_dir), NOW, window=WINDOW)


PLUGIN_WORD = "the"


@register("external_command", S.with_(S.ITEMS_CTE) + f"""
select pos, url, title from items where contains(lower(title), '{PLUGIN_WORD}')""")
def q_external_command(spark, sf_dir):
    import os
    from ..operators.plugin import external_command
    script = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))),
                          "scripts", "plugins", "keep_title_word.py")
    out = external_command(_items(spark, sf_dir), "python3", [script, PLUGIN_WORD], timeout="120s",
                           name="keep_title_word")
    return out.select("pos", "url", "title")


CHAIN_CONFIG = {
    "stages": [
        {"type": "normalize"},
        {"type": "merge"},
        {"type": "keyword", "include": KEYWORD_INCLUDE, "exclude": KEYWORD_EXCLUDE, "min_score": 1},
        {"type": "domain-filter", "exclude": DOMAIN_EXCLUDE},
        {"type": "since", "since": WINDOW},
        {"type": "hatena"},
        {"type": "hotness"},
        {"type": "min-hotness", "min": MIN_HOTNESS},
        {"type": "source", "default_source": DEFAULT_SOURCE},
        {"type": "summary"},
        {"type": "rank", "by": "hotness"},
    ]
}


def _chain_sql():
    t = _kw_text_sql()
    score = " + ".join(f"cast(contains({t}, {S.q(p)}) as integer)" for p in KEYWORD_INCLUDE)
    excl = " or ".join(f"contains({t}, {S.q(p)})" for p in KEYWORD_EXCLUDE)
    dm = " or ".join(f"(dom = {S.q(p)} or ends_with(dom, {S.q('.' + p)}))" for p in DOMAIN_EXCLUDE)
    fne = f"coalesce(nullif({S.go_trim('description')}, ''), nullif({S.go_trim('title')}, ''), '')"
    cl = S.clean(fne)
    return S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + f"""
, m as (select * from (select *, row_number() over (partition by nkey order by pos) rn from items) where rn = 1),
k as (select *, ({score}) as keyword_score, ({excl}) as excluded, {S.domain('nkey')} as dom from m),
f as (select * from k where not excluded and keyword_score > 0 and (dom = '' or not ({dm}))
        and published_at >= {S.NOW} - interval 240 hour),
h as (select f.*, coalesce(cast(b.n as varchar), '') as bookmark_count,
        {S.hotness('coalesce(b.n, 0)', 'coalesce(c.n, 0)', 'f.published_at')} as hotness_score
      from f left join bcounts b on b.url = f.url left join ccounts c on c.url = f.url)
select pos, url, keyword_score, hotness_score, source,
  (case when length({cl}) <= 160 then {cl} else left({cl}, 157) || '...' end) as summary,
  case when bookmark_count not in ('', '0') then 'Hatena Bookmark: ' || bookmark_count
       when source <> '' then 'source: ' || source else 'source feed item' end as reading_reason
from h where hotness_score >= {MIN_HOTNESS}"""


@register("config_chain", _chain_sql())
def q_config_chain(spark, sf_dir):
    ctx = _stages.Context(now=NOW, comments=tables.comments_view(spark, sf_dir),
                          bookmark_counts=tables.bookmark_counts_view(spark, sf_dir))
    out = _stages.run_stages(_items(spark, sf_dir), _stages.build_stages(CHAIN_CONFIG), ctx)
    return out.select("pos", "url", "keyword_score", "hotness_score", "source", "summary", "reading_reason")


# ------------------------------------------------------------ streaming -----

from ..streaming import jobs as _stream  # noqa: E402


@register("stream_jsonl_ingest", S.with_(S.ITEMS_CTE) + _kw_sql().split(S.with_(S.ITEMS_CTE), 1)[1]
          .replace("select pos, url, keyword_score from", "select url, keyword_score from"))
def q_stream_jsonl_ingest(spark, sf_dir):
    """Items arrive as JSON Lines files; the stream applies normalize +
    keyword filter per micro-batch (one file per trigger)."""
    src, out, ck = work_dir(spark, "in"), work_dir(spark, "out"), work_dir(spark, "ck")
    _jsonl.jsonl_records(_items(spark, sf_dir)).select("line").write.text(src)
    stream = _stream.ingest_items_stream(spark, src, max_files_per_trigger=1)
    kept = filters.keyword_filter(normalize_items(stream), KEYWORD_INCLUDE, KEYWORD_EXCLUDE, KEYWORD_MIN_SCORE)
    _stream.run_available_now(kept.select("url", "keyword_score"), ck, fmt="parquet", path=out)
    return spark.read.parquet(out)


@register("stream_comment_delta", _DELTA_CTE + """
select 'comment' as kind, entry_key, thread_id, "user", strftime(ct, '%Y-%m-%dT%H:%M:%SZ') as comment_time,
  '*' || "user" || '* さん: ' || comment as text,
  sha256(length(entry_key) || ':' || entry_key || length("user") || ':' || "user" || length(ts_text) || ':' || ts_text || length(comment) || ':' || comment) as message_id
from newc
union all select 'parent', entry_key, thread_id, null, null, description, thread_id from ent where not (by_key or by_url)""")
def q_stream_comment_delta(spark, sf_dir):
    """Comments arrive as a stream; per-entry state (last time sent) lives
    in ``applyInPandasWithState``; entries/state lookups are static."""
    src, out, ck = work_dir(spark, "comments"), work_dir(spark, "outbox"), work_dir(spark, "ck")
    tables.comments_view(spark, sf_dir).repartitionByRange("ord").write.parquet(src)
    items = _items(spark, sf_dir)
    entries = _delta._entries(items, tables.prior_state_view(spark, sf_dir)).checkpoint(eager=True)
    links = items.select("url", _delta.entry_key("url").alias("entry_key")).distinct()
    lookup = links.join(entries.select("entry_key", "last_time", "thread_id"), "entry_key")
    lookup = lookup.checkpoint(eager=True)   # static side: computed once, not per micro-batch
    stream = _stream.read_comments_stream(spark, src)
    _stream.run_available_now(_stream.comment_delta_stream(stream, lookup), ck, fmt="parquet", path=out)
    return spark.read.parquet(out).unionByName(_stream.opening_messages(entries))


@register("stream_dedup_archive", S.with_(S.ITEMS_CTE) + """
select pos, url, nkey as dedup_key from (
  select *, row_number() over (partition by nkey order by pos) rn from items) where rn = 1""")
def q_stream_dedup_archive(spark, sf_dir):
    """Two arrivals: the items, then their tracking-parameter variants; the
    archive keeps the first arrival of every key (foreachBatch + anti-join)."""
    src, arch, ck = work_dir(spark, "items"), work_dir(spark, "archive"), work_dir(spark, "ck")
    originals = _items(spark, sf_dir)
    schema = originals.schema
    originals.write.parquet(f"{src}/part=0")
    sink = _stream.dedup_archive_batch(arch)
    stream = spark.readStream.schema(schema).parquet(f"{src}/*")
    _stream.run_available_now(stream, ck, sink=sink)
    (tables.tracking_variants_view(spark, sf_dir)
     .withColumn("pos", F.col("pos") + F.lit(1 << 40)).select(*schema.names).write.parquet(f"{src}/part=1"))
    stream = spark.readStream.schema(schema).parquet(f"{src}/*")
    _stream.run_available_now(stream, ck, sink=sink)
    a = spark.read.parquet(arch)
    return a.select("pos", "url", F.col("_key").alias("dedup_key"))


# -------------------------------------------------------------- messages ----

from ..sinks import messages as _messages  # noqa: E402


@register("notification_messages", S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + """
select i.pos, 'post' as kind, '<' || i.url || '|' || i.title || '>' as text,
  i.description || chr(10) || chr(10)
  || case when b.n is not null and cast(b.n as varchar) <> '0' then 'Hatena Bookmark: *' || cast(b.n as varchar) || '*' || chr(10) else '' end
  || case when coalesce(c.n, 0) > 0 then 'Hatena Comments: ' || cast(c.n as varchar) || chr(10) else '' end as attachment,
  sha256('4:post' || length(cast(i.pos as varchar)) || ':' || cast(i.pos as varchar) || length(i.url) || ':' || i.url) as message_id
from items i left join bcounts b on b.url = i.url left join ccounts c on c.url = i.url""")
def q_notification_messages(spark, sf_dir):
    return _messages.notification_messages(_enriched(spark, sf_dir))


def _go_quote_sql(x: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = f"replace({x}, {S.q(a) if a != chr(10) and a != chr(13) and a != chr(9) else 'chr(' + str(ord(a)) + ')'}, {S.q(b)})"
    return f"('\"' || {x} || '\"')"


@register("dry_run_plan", S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + f"""
, e as (select i.*, coalesce(cast(b.n as varchar), '') as cnt, coalesce(c.n, 0) as cc,
          row_number() over (order by i.pos) as n
        from items i left join bcounts b on b.url = i.url left join ccounts c on c.url = i.url)
select cast(0 as bigint) as k1, cast(0 as bigint) as k2, cast(0 as bigint) as k3, 'slack dry-run: channel=(unset) posts=' || cast((select count(*) from e) as varchar) as line
union all
select 1, n, 0, cast(n as varchar) || '. message title=' || {_go_quote_sql('title')} || ' url=' || {_go_quote_sql('url')} from e
union all
select 1, n, 1, '   hatena_bookmark_count=' || cnt || ' comments=' || cast(cc as varchar) from e where cnt <> ''""")
def q_dry_run_plan(spark, sf_dir):
    return _messages.dry_run_lines(_enriched(spark, sf_dir))


# ----------------------------------------------------- documents and tables --

from ..sinks import feeds as _sink_feeds  # noqa: E402
from ..sinks import tables as _sink_tables  # noqa: E402


def _rss_sql():
    from ..sinks.feeds import FEED_DESCRIPTION, FEED_TITLE
    now_txt = NOW.strftime("%a, %d %b %Y %H:%M:%S +0000")
    head = ('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" '
            'xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>'
            + FEED_TITLE + "</title><link></link><description>" + FEED_DESCRIPTION
            + "</description><pubDate>" + now_txt + "</pubDate>")
    desc_head = ("i.description || case when b.n is not null and cast(b.n as varchar) <> '0' then chr(10) || "
                 "'<p>Hatena Bookmark: <b>' || cast(b.n as varchar) || '</b></p>' else '' end || "
                 "case when c.n is not null then chr(10) || '<p><b>Comments:</b></p><ul>' else '' end")
    tail = "case when c.n is not null then '</ul>' else '' end"
    pub = f"strftime(coalesce(i.published_at, {S.NOW}), '%a, %d %b %Y %H:%M:%S +0000')"
    li = S.xml_escape("'<li>' || cm.\"user\" || ' (' || cm.ts_text || '): ' || cm.comment || '</li>'")
    return S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + f"""
, it as (select i.*, b.n as bn, c.n as cn,
    '<item><title>' || {S.xml_escape('i.title')} || '</title><link>' || {S.xml_escape('i.url')}
      || '</link><description>' || {S.xml_escape(desc_head)} as head,
    {S.xml_escape(tail)} || '</description><pubDate>' || {pub} || '</pubDate></item>' as foot
  from items i left join bcounts b on b.url = i.url left join ccounts c on c.url = i.url)
select cast(0 as bigint) as k1, cast(0 as bigint) as k2, cast(0 as bigint) as k3, {S.q(head)} as line
union all select 1, pos, 0, head from it
union all select 1, pos, {1 << 62}, foot from it
union all select 1, i.pos, cm.ord + 1, {li} from items i join comments cm on cm.url = i.url where cm.comment <> ''
union all select 2, 0, 0, '</channel></rss>'"""


@register("rss_feed", _rss_sql())
def q_rss_feed(spark, sf_dir):
    """RSS document of the enriched items (rows in document order)."""
    return _sink_feeds.rss_lines(_enriched(spark, sf_dir), tables.comments_view(spark, sf_dir), NOW)


@register("state_store_roundtrip", _DELTA_CTE + """
select entry_key,
  case when mx is not null and mx > strptime(last_txt, '%Y-%m-%dT%H:%M:%SZ')
       then strftime(mx, '%Y-%m-%dT%H:%M:%SZ') else last_txt end as last_comment_timestamp,
  thread_id
from plan
union all
select p.entry_key, p.last_comment_timestamp, p.thread_id from prior p
where not exists (select 1 from ent n where n.entry_key = p.entry_key)
  and not exists (select 1 from ent n where n.by_url and n.url = p.entry_key)""")
def q_state_store_roundtrip(spark, sf_dir):
    """Prior state saved as version 1, the run's next state saved as
    version 2 (while version 1 is the input), then the latest version read."""
    store = _sink_tables.StateStore(spark, work_dir(spark, "state"))
    store.save(tables.prior_state_view(spark, sf_dir))
    r = _delta.comment_delta(_items(spark, sf_dir), tables.comments_view(spark, sf_dir), store.load())
    store.save(r.new_state)
    return store.load()


@register("archive_roundtrip", S.with_(S.ITEMS_CTE) + """
select pos, url, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') as published,
  replace(replace('https://feeds.example.com/' || source, 'http://', ''), 'https://', '') as feed_key
from items""")
def q_archive_roundtrip(spark, sf_dir):
    """Items archived per feed (feed link = one feed per document source),
    written as a new version and read back."""
    path = work_dir(spark, "archive")
    items = _items(spark, sf_dir).withColumn(
        "feed_link", F.concat(F.lit("https://feeds.example.com/"), F.col("source")))
    _sink_tables.write_archive(items, path)
    schema = items.withColumn("feed_key", F.lit("")).schema
    back = _sink_tables.read_archive(spark, path, schema)
    return back.select("pos", "url", "title", _fmt_ts(F.col("published_at")).alias("published"), "feed_key")


@register("archive_of_feed", S.with_(S.ITEMS_CTE) + """
select pos, url, strftime(published_at, '%Y-%m-%d %H:%M:%S') as published,
  row_number() over (order by published_at desc nulls last, pos) as rank from items where source = 'src3'""")
def q_archive_of_feed(spark, sf_dir):
    """One feed of the archive, newest first."""
    path = work_dir(spark, "archive")
    items = _items(spark, sf_dir).withColumn("feed_link", F.concat(F.lit("https://feeds.example.com/"), F.col("source")))
    _sink_tables.write_archive(items, path)
    schema = items.withColumn("feed_key", F.lit("")).schema
    feed = _sink_tables.read_archive(spark, path, schema, "feeds.example.com/src3")
    ranked = rank.with_rank(feed, rank.rank_order(feed, "published"))
    return ranked.select("pos", "url", _fmt_ts(F.col("published_at")).alias("published"), "rank")


@register("function_stage", S.with_(S.ITEMS_CTE) + """
select pos, url, upper(source) as source_label, 'of ' || upper(source) as reading_reason from items where source <> ''""")
def q_function_stage(spark, sf_dir):
    """User functions as stages, chained with a built-in one."""
    chain = [_stages.FunctionStage("label", lambda df: df.withColumn("source", F.upper("source"))),
             _stages.SourceLabelStage(""),
             _stages.FunctionStage("reason", lambda df: df.filter(F.col("source_label").isNotNull()).withColumn(
                 "reading_reason", F.concat(F.lit("of "), F.col("source_label"))))]
    out = _stages.run_stages(_items(spark, sf_dir), chain, _stages.Context(now=NOW))
    return out.select("pos", "url", "source_label", "reading_reason")


@register("explain_edges", S.with_(S.ITEMS_CTE) + """
select 'none' as which, 'rss' as output, true as kept, 'no filter/rank criteria' as reasons, count(*) as n from items
union all select 'rank', 'atom', false, 'rank: unsupported rank sideways', count(*) from items
union all select 'dry', 'rss', true, 'diff: would drop items present in the existing set', count(*) from items
union all select 'error', 'rss', true, 'pipeline error: bad flag | no filter/rank criteria', count(*) from items""")
def q_explain_edges(spark, sf_dir):
    """Explain without stages, with an unsupported rank, with a dry-run stage,
    with a builder error, and with another output name."""
    from .. import reasons as R
    items = _items(spark, sf_dir)
    ctx = _stages.Context(now=NOW)
    runs = {"none": _explain_items(items, [], ctx),
            "rank": _explain_items(items, [_stages.RankStage("sideways")], ctx, output="atom"),
            "dry": _explain_items(items, [_stages.DiffStage(items)], ctx),
            "error": _explain_items(items, [], ctx, errors=["bad flag"])}
    out = None
    for which, ex in runs.items():
        text = F.regexp_replace(F.array_join("reasons", " | "), "^" + R.BUILDER_ERROR, "pipeline error: ")
        part = ex.groupBy(F.lit(which).alias("which"), "output", "kept", text.alias("reasons")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@register("null_rows", "select count(*) as n from documents")
def q_null_rows(spark, sf_dir):
    """Rows without an item among the documents' items are skipped."""
    from ..operators.items import drop_null_rows
    docs = tables.read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit(tables.DOCUMENT_LINK), F.col("doc_id").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("id"))
    nothing = docs.select(*[F.lit(None).cast("string").alias(c) for c in docs.columns])
    return drop_null_rows(docs.unionByName(nothing)).agg(F.count("*").alias("n"))


@register("null_rows_kept", """
select * from (select doc_id, case when n_chars % 2 = 0 then 'u' || doc_id end as url, case when n_chars % 3 = 0 then coalesce(lang, '') end as title,
  case when n_chars % 5 = 0 then '' end as id from documents) where url is not null or title is not null or id is not null""")
def q_null_rows_kept(spark, sf_dir):
    """Items with each choice of missing fields: only those without any go."""
    from ..operators.items import drop_null_rows
    some = lambda k, value: F.when(F.col("n_chars") % k == 0, value)
    return drop_null_rows(tables.read_table(spark, sf_dir, "documents").select(
        "doc_id", some(2, F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("url"),
        some(3, F.coalesce("lang", F.lit(""))).alias("title"), some(5, F.lit("")).alias("id")))


@register("score_text", """
select doc_id, cast(round(n_chars / 7.0, 3) as double) as score, 0.0::double as junk, 0.0::double as missing from documents""")
def q_score_text(spark, sf_dir):
    """Scores written as text and read back; junk and missing text count 0."""
    from ..functions.text import format_score, parse_score
    docs = tables.read_table(spark, sf_dir, "documents")
    text = format_score(F.round(F.col("n_chars") / 7.0, 3).cast("double"))
    return docs.select("doc_id", parse_score(text).alias("score"), parse_score(F.concat(F.lit("x"), text)).alias("junk"),
                       parse_score(F.lit(None).cast("string")).alias("missing"))


@register("strict_printable", r"""
select doc_id, sha256(regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}\p{N}\p{P}\p{S} ]', '', 'g')) as printable from documents""")
def q_strict_printable(spark, sf_dir):
    from ..sources.feeds import clean_chunk
    docs = tables.read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(clean_chunk(F.coalesce("text", F.lit("")), strict_printable=True), 256).alias("printable"))


@register("config_run", S.with_(S.ITEMS_CTE) + """
select url, title, nkey as normalized_url from (
  select *, row_number() over (partition by nkey order by pos) as rn from items) where rn = 1""")
def q_config_run(spark, sf_dir):
    """A whole config: two item files in, stages, JSON Lines out."""
    path = work_dir(spark, "config")
    items = _items(spark, sf_dir)
    for name, part in (("a", items), ("b", tables.tracking_variants_view(spark, sf_dir))):
        _jsonl.jsonl_records(part).orderBy("pos").select("line").write.text(f"{path}/{name}")
    config = {"input": {"format": "jsonl", "urls": [f"{path}/a", f"{path}/b"]}, "output": {"type": "jsonl"},
              "stages": [{"type": "normalize"}, {"type": "merge"}]}
    out = _stages.run_config(spark, config, _stages.Context(now=NOW))
    get = lambda k: F.coalesce(F.get_json_object("line", f"$.{k}"), F.lit(""))
    return out.select(*[get(k).alias(k) for k in ("url", "title", "normalized_url")])


@register("lint_merged", S.with_(S.ITEMS_CTE) + _BAD_DOCS_CTE + """
select run, count(*) as errors from docs, (values (0), (1)) v(run) where bad = 1 group by run""")
def q_lint_merged(spark, sf_dir):
    """Error lists of two runs over the same feeds, merged.  The feeds are parsed
    for one error list, which both runs then read."""
    docs = _src_feeds.parse_feeds(_src_feeds.read_feed_text(spark, _feed_stream_dir(spark, sf_dir)))
    found, path = _lint.lint_errors(docs), work_dir(spark, "lint")
    found.write.parquet(path)
    errors = spark.read.schema(found.schema).parquet(path)
    return _lint.merge_lint_errors(errors, errors).groupBy("run").agg(F.count("*").alias("errors"))


@register("json_array", S.with_(S.ITEMS_CTE) + """
select url, title, nkey as normalized_url, source from items""")
def q_json_array(spark, sf_dir):
    """Items as one JSON array, its element lines read back."""
    doc = _jsonl.json_array_lines(_items(spark, sf_dir))
    line = F.regexp_replace(F.col("line"), "^(  |, )", "")
    get = lambda k: F.coalesce(F.get_json_object(line, f"$.{k}"), F.lit(""))
    return doc.filter("k1 = 1").select(*[get(k).alias(k) for k in ("url", "title", "normalized_url", "source")])


@register("feed_bodies", """
select 'https://pier.test/' || doc_id as url, 'item ' || doc_id as title, 'feed ' || coalesce(source, '') as source from documents
where coalesce(lang, '') <> 'es'""")
def q_feed_bodies(spark, sf_dir):
    """One captured feed per document; feeds that were not captured are skipped."""
    docs = tables.read_table(spark, sf_dir, "documents")
    id_text = F.col("doc_id").cast("string")
    body = F.concat(F.lit('<rss version="2.0"><channel><title>feed '), F.coalesce("source", F.lit("")), F.lit("</title><item><title>item "),
                    id_text, F.lit("</title><link>https://pier.test/"), id_text, F.lit("</link></item></channel></rss>"))
    bodies = docs.select(F.concat(F.lit("https://pier.test/feed/"), id_text).alias("feed_url"),
                         F.when(F.coalesce("lang", F.lit("")) != "es", body).alias("body"))
    return _src_feeds.feed_bodies_items(bodies).select("url", "title", "source")


@register("comment_bodies", S.with_(S.EVENTS_CTE) + """
select url, "user", comment, ts_text as "timestamp", tag from comments""")
def q_comment_bodies(spark, sf_dir):
    """Captured comment responses, one comment each, read into the comments table."""
    from ..sources.snapshots import comments_from_bodies
    c = tables.comments_view(spark, sf_dir)
    body = F.to_json(F.struct(F.array(F.struct("user", "comment", "timestamp", "tags")).alias("bookmarks")))
    got = comments_from_bodies(c.select("url", body.alias("body")))
    return got.select("url", "user", "comment", "timestamp", F.array_join("tags", ",").alias("tag"))


def _atom_sql():
    from ..sinks.feeds import FEED_DESCRIPTION, FEED_TITLE
    head = ('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>'
            + FEED_TITLE + "</title><id></id><updated>" + NOW.strftime("%Y-%m-%dT%H:%M:%SZ")
            + "</updated><subtitle>" + FEED_DESCRIPTION + "</subtitle>")
    desc_head = ("i.description || case when b.n is not null and cast(b.n as varchar) <> '0' then chr(10) || "
                 "'<p>Hatena Bookmark: <b>' || cast(b.n as varchar) || '</b></p>' else '' end")
    upd = f"strftime(coalesce(i.published_at, {S.NOW}), '%Y-%m-%dT%H:%M:%SZ')"
    return S.with_(S.ITEMS_CTE, S.EVENTS_CTE) + f"""
, it as (select i.pos,
    '<entry><title>' || {S.xml_escape('i.title')} || '</title><updated>' || {upd} || '</updated><id>'
      || {S.xml_escape('i.url')} || '</id><link href="' || {S.xml_escape('i.url')}
      || '" rel="alternate"></link><summary type="html">' || {S.xml_escape(desc_head)} as head
  from items i left join bcounts b on b.url = i.url)
select cast(0 as bigint) as k1, cast(0 as bigint) as k2, cast(0 as bigint) as k3, {S.q(head)} as line
union all select 1, pos, 0, head from it
union all select 1, pos, {1 << 62}, '</summary></entry>' from it
union all select 2, 0, 0, '</feed>'"""


@register("atom_feed", _atom_sql())
def q_atom_feed(spark, sf_dir):
    """Atom document of the enriched items (no comment list)."""
    return _sink_feeds.atom_lines(_enriched(spark, sf_dir), None, NOW)


def _explain_jsonl_sql():
    base = _explain_sql()
    cte = base[:base.index("\nselect pos, a5 as kept,")]
    n_stages = ("2 + cast(mk as int) + cast(coalesce(a2, false) as int) + cast(coalesce(a3, false) as int)"
                " + 2 * cast(coalesce(a4, false) as int) + cast(coalesce(a5, false) as int)")
    return cte + f"""
select pos, 'feedloom.explain.v1' as schema_version, case when a5 then 'true' else 'false' end as kept,
  cast({n_stages} as int) as n_stages, 'normalize: set normalized_url/id' as first_reason,
  case when a5 then cast(score as varchar) end as keyword_score,
  case when a5 then printf('%.3f', hot) end as hotness_score,
  case when a5 and dom <> '' then dom end as domain
from h"""


@register("explain_jsonl", _explain_jsonl_sql())
def q_explain_jsonl(spark, sf_dir):
    """Explain records written as JSON Lines, read back field by field."""
    from ..sinks.jsonl import explain_records
    ex = _explain_items(_items(spark, sf_dir), _explain_stage_list(), _stages.Context(now=NOW))
    lines = explain_records(ex)
    g = lambda p: F.get_json_object("line", p)
    return lines.select(
        "pos", g("$.schema_version").alias("schema_version"), g("$.kept").alias("kept"),
        F.json_array_length(g("$.stages")).alias("n_stages"), g("$.reasons[0]").alias("first_reason"),
        g("$.item.metadata.keyword_score").alias("keyword_score"),
        g("$.item.metadata.hotness_score").alias("hotness_score"),
        g("$.item.metadata.domain").alias("domain"))


def _feed_bodies(spark, sf_dir) -> DataFrame:
    """Captured feed bodies: one RSS document per 20 consecutive items (a
    document holding a spam-farm link has a broken root); documents hold at
    most DOC_SIZE items, so assembling one is bounded."""
    items = _items(spark, sf_dir).withColumn("_doc", F.floor(F.col("pos") / DOC_SIZE).cast("long"))
    items = items.withColumn("_title", F.concat(F.lit("feed "), F.col("_doc").cast("string")))
    lines = _feeds.feed_stream_lines(items, "_doc", "_title")
    bad = items.groupBy("_doc").agg(F.max(F.contains("url", F.lit(BAD_DOC_MARK)).cast("int")).alias("_bad"))
    lines = lines.join(bad.withColumnRenamed("_doc", "k1"), "k1").withColumn(
        "line", F.when((F.col("_bad") == 1) & (F.col("k2") == 0),
                       F.replace("line", F.lit('<rss version="2.0">'), F.lit("<html>"))).otherwise(F.col("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k2", "k3", "line"))),
                                    lambda x: x["line"]), "")
    return lines.groupBy("k1").agg(body.alias("body")).select(
        F.format_string("https://feeds.example.com/doc/%05d", F.col("k1")).alias("feed_url"), "body")


@register("lint_feed_urls", S.with_(S.ITEMS_CTE) + _BAD_DOCS_CTE + f"""
select cast(0 as bigint) as k1, '' as k2,
  'feeds: total=' || cast(count(*) as varchar) || ' valid=' || cast(count(*) filter (where bad = 0) as varchar)
  || ' invalid=' || cast(count(*) filter (where bad = 1) as varchar) as line from docs
union all
select cast(1 as bigint), printf('https://feeds.example.com/doc/%05d', doc),
  '- ' || printf('https://feeds.example.com/doc/%05d', doc) || ': XML syntax error' from docs where bad = 1""")
def q_lint_feed_urls(spark, sf_dir):
    """Lint report over captured feed bodies (one feed per URL)."""
    return _lint.lint_feed_report(_lint.lint_feed_bodies(_feed_bodies(spark, sf_dir)))


@register("stream_delta_batches", _DELTA_CTE + """
select 'parent' as kind, entry_key, thread_id, null as "user", null as comment_time,
  description as text, thread_id as message_id
from ent where not (by_key or by_url)
union all
select 'comment', entry_key, thread_id, "user", strftime(ct, '%Y-%m-%dT%H:%M:%SZ'),
  '*' || "user" || '* さん: ' || comment, sha256(length(entry_key) || ':' || entry_key || length("user") || ':' || "user" || length(ts_text) || ':' || ts_text || length(comment) || ':' || comment)
from newc""")
def q_stream_delta_batches(spark, sf_dir):
    """Comments arrive as a stream; every micro-batch runs the batch delta
    against the versioned state table and appends to the outbox."""
    src, ck = work_dir(spark, "comments"), work_dir(spark, "ck")
    state_path, outbox_path = work_dir(spark, "state"), work_dir(spark, "outbox")
    tables.comments_view(spark, sf_dir).write.parquet(src)
    _sink_tables.StateStore(spark, state_path).save(tables.prior_state_view(spark, sf_dir))
    sink = _stream.comment_delta_batches(_items(spark, sf_dir), state_path, outbox_path)
    _stream.run_available_now(_stream.read_comments_stream(spark, src), ck, sink=sink)
    return spark.read.parquet(outbox_path).select(
        "kind", "entry_key", "thread_id", "user", "comment_time", "text", "message_id")


@register("comment_delta_dry_run", _DELTA_CTE + f"""
, pl as (select p.*, e.pos, e.title from plan p join ent e on e.entry_key = p.entry_key)
select cast(0 as bigint) as k1, cast(pos as bigint) as k2, cast(0 as bigint) as k3,
  'hatena dry-run: title=' || {_go_quote_sql('title')} || ' url=' || {_go_quote_sql('url')}
  || ' parent_post=' || case when parent_post then 'true' else 'false' end
  || ' new_comments=' || cast(new_comments as varchar) as line from pl
union all
select 1, 0, 0, 'hatena dry-run summary: channel=(unset) parent_posts='
  || cast(coalesce(sum(cast(parent_post as bigint)), 0) as varchar)
  || ' comment_posts=' || cast(coalesce(sum(new_comments), 0) as varchar) from pl""")
def q_comment_delta_dry_run(spark, sf_dir):
    """The delta plan as dry-run text lines (per entry, then totals)."""
    return _messages.delta_dry_run_lines(_delta_result(spark, sf_dir).plan)
