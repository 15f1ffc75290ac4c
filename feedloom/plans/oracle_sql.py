"""DuckDB SQL forms of the registered queries (the correctness oracle).

The fragments mirror the Spark column expressions one to one; they are
plain SQL over the stored tables (``pages``, ``documents``, ``events``).
"""

from __future__ import annotations

# The oracle's own constants: references that the stored tables contain, the
# removed elements and the containers in order of preference.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&amp;", "&")]
REMOVED = ["script", "style", "nav", "footer", "header", "noscript"]
CONTAINERS = ["article", "main", "body"]

URL_RX = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?]([^#]*))?(#.*)?$"
WS = r"[\s\x{0B}\x{85}\p{Z}]+"
NOW = "timestamp '2024-01-31 00:00:00'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unescape(x: str) -> str:
    for ent, ch in ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def go_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def clean(x: str) -> str:
    return go_trim(f"regexp_replace({x}, '{WS}', ' ', 'g')")


def norm_url(u: str) -> str:
    t = go_trim(u)
    g = lambda i: f"regexp_extract({t}, '{URL_RX}', {i})"
    host = f"regexp_replace(lower({g(2)}), '^m[.]', '')"
    p0 = f"regexp_replace(regexp_replace({g(3)}, '/amp/$', ''), '/amp$', '')"
    path = f"(case when {p0} = '/' then {p0} else regexp_replace({p0}, '/+$', '') end)"
    nq = (f"array_to_string(list_sort(list_filter(string_split({g(5)}, '&'), lambda x: x <> '' and "
          f"not regexp_matches(lower(x), '^(utm_|fbclid=|gclid=)'))), '&')")
    qpart = f"(case when {nq} <> '' then '?' || {nq} else '' end)"
    return (f"(case when {t} = '' then '' when regexp_matches({t}, '{URL_RX}') and {g(2)} <> '' then "
            f"lower({g(1)}) || '://' || {host} || {path} || {qpart} else {t} end)")


def domain(norm: str) -> str:
    h = f"regexp_replace(lower(regexp_extract({norm}, '{URL_RX}', 2)), ':[0-9]*$', '')"
    return f"regexp_replace({h}, '^www[.]', '')"


def page_title(html: str) -> str:
    return go_trim(unescape(f"regexp_extract({html}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"))


def readable_text(html: str) -> str:
    doc = f"regexp_replace(coalesce({html}, ''), '(?s)<!--.*?-->', '', 'g')"
    for t in REMOVED:
        doc = f"regexp_replace({doc}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"

    def text_of(frag: str) -> str:
        return clean(unescape(f"regexp_replace({frag}, '(?s)<[^>]*>', '', 'g')"))

    parts = []
    for tag in CONTAINERS:
        if tag == "body":
            inner = (f"(case when regexp_matches(d.doc, '(?is)<body\\b') then "
                     f"regexp_extract(d.doc, '(?is)<body\\b[^>]*>(.*?)(</body\\s*>|$)', 1) else "
                     f"regexp_replace(d.doc, '(?is)<head\\b[^>]*>.*?</head\\s*>', '', 'g') end)")
        else:
            inner = f"regexp_extract(d.doc, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"
        parts.append(f"nullif({text_of(inner)}, '')")
    return doc, f"coalesce({', '.join(parts)}, '')"


ITEMS_CTE = f"""
items0 as (
  select coalesce(p.page_id, d.doc_id) as pos, p.html as html, d.source as dsource, d.lang as dlang, d.text as dtext,
    case when p.page_id is null then 'https://documents.example.org/d/' || cast(d.doc_id as varchar)
         else coalesce(p.url, '') end as url
  from pages p full join documents d on d.doc_id = p.page_id
),
items as (
  select pos, url, {page_title("coalesce(html, '')")} as title,
    case when pos % 17 = 0 then null
         else timestamp '2024-01-01 00:00:00' + to_hours(cast((pos*7) % 720 as int)) end as published_at,
    coalesce(dsource, '') as source, coalesce(dlang, '') as lang,
    coalesce(dtext, '') as description, {norm_url('url')} as nkey
  from items0
)"""

EVENTS_CTE = """
ev as (
  select e.*, pg.url as url from events e
  join pages pg on pg.page_id = e.event_id % (select count(*) from pages)
),
comments as (
  select url, event_id as ord, 'u' || cast(user_id as varchar) as "user",
    event_type || ' ' || props as comment, strftime(ts, '%Y/%m/%d %H:%M') as ts_text,
    event_type as tag, ts
  from ev where event_type <> 'view'
),
bcounts as (
  select url, count(*) as n from ev where event_type = 'view' group by url
),
ccounts as (
  select url, count(*) as n from comments group by url
)"""

VARIANTS_CTE = f"""
variants0 as (
  select pos * 2 + case when contains(url, '?') then 1 else 0 end as pos, url, title, published_at from items
  union all
  select pos * 2 + case when contains(url, '?') then 0 else 1 end as pos,
    split_part(url, '#', 1) || case when contains(url, '?') then '&' else '?' end || 'utm_medium=rss' as url,
    title, published_at from items
),
variants as (select *, {norm_url('url')} as nkey from variants0)"""


def hotness(b: str, c: str, pub: str) -> str:
    age = (f"greatest(cast(0 as double), coalesce(date_diff('microsecond', {pub}, {NOW}) / cast(3600000000 as double), "
           f"cast(24 as double)))")
    return (f"round(cast({b} as double) * 1.5 + cast({c} as double) * 2.0 + "
            f"cast(10 as double) * (cast(24 as double) / ({age} + cast(24 as double))), 3)")


def with_(*ctes: str) -> str:
    return "with " + ",".join(ctes) + "\n"


def xml_escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x
