"""HTML page helpers: readable text and page metadata.

Two Arrow-batched UDFs walk a page's tags from left to right, with quoted
attributes and nested elements, over whole pages.  One collects the text of the
first ``article``, the first ``main`` and the ``body`` (without script, style,
nav, footer, header and noscript elements and comments), the other the ``<meta>``
tags, without texts.  Both turn the pages of a batch into Python strings one by
one, so a worker holds the batch as Arrow sends it and one page.
White space and the choice among the containers are left to the JVM, as is the
page title, whose element holds no others."""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean_text, col_, go_trim, html_unescape

# The removed elements, the searched ones, and the metadata keys.
REMOVED_ELEMENTS = ["script", "style", "nav", "footer", "header", "noscript"]
READABLE_CONTAINERS = ["article", "main", "body"]
META_KEYS = ["og:title", "og:description", "og:image", "og:site_name", "description"]

# What can start a markup token; a name ends at white space, "/", "<" or ">".
_OPENER = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/<>]*+))")
_ATTRIBUTES = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_DELIMITER = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_TEXT = {n: re.compile(rf"</{n}\s*+>", re.I) for n in ("script", "style", "textarea", "title")}
_METAS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _tag_ends(page: str, start: int) -> tuple[list[int], list[int]]:
    """The places of ``>``, ``"`` and ``'`` from ``start`` on, and for each of them
    where a tag ends that is outside of quotes there (-1: nowhere)."""
    places = [m.start() for m in _DELIMITER.finditer(page, start)]
    ends = [-1] * len(places)
    outside = in_double = in_single = -1
    for k in range(len(places) - 1, -1, -1):
        mark = page[places[k]]
        if mark == ">":
            outside = places[k]
        elif mark == '"':
            outside, in_double = in_double, outside
        else:
            outside, in_single = in_single, outside
        ends[k] = outside
    return places, ends


def _tokens(page: str) -> Generator[tuple[int, int, bool, str, str], int | None, None]:
    """``(start, end, closes, name, attributes)`` of the tags, comments and
    declarations (these two without a name), in order.  The consumer may send a
    place from which to go on.

    Each character is looked at a bounded number of times: a tag that nothing
    ends is text, and the first of them has the ends of all later tags worked out
    in one pass from the back; a declaration without an end has no ``>`` behind it."""
    at, last_end, known = 0, page.rfind(">"), None
    while m := _OPENER.search(page, at):
        start, at, rest = m.start(), m.end(), ""
        if m[1]:
            end = page.find("-->", at)
            end = len(page) if end < 0 else end + 3
        elif start > last_end:
            continue
        elif m[2]:
            end = page.index(">", at) + 1
        else:
            if known is None and not (a := _ATTRIBUTES.match(page, at)):
                known = _tag_ends(page, at)
            if known is None:
                rest, end = a[1], a.end()
            else:
                places, ends = known
                k = bisect_left(places, at)
                if k == len(places) or ends[k] < 0:
                    continue
                rest, end = page[at:ends[k]], ends[k] + 1
        at = (yield start, end, bool(m[3]), m[4] or "", rest) or end


def _next(tokens: Generator, resume: int | None) -> tuple | None:
    try:
        return next(tokens) if resume is None else tokens.send(resume)
    except StopIteration:
        return None


def _page_parts(page: str, with_texts: bool = True) -> tuple[list[str], list[tuple[str, str]]]:
    """Texts of the containers (none with ``with_texts`` off), and (key, value) of the meta tags."""
    texts = {name: [] for name in READABLE_CONTAINERS}
    depth = dict.fromkeys([*READABLE_CONTAINERS, *REMOVED_ELEMENTS, "head"], 0)
    closed, seen_body, outside, metas, at = set(), False, [], [], 0

    def text(end: int) -> None:
        if with_texts and end > at and not any(depth[r] for r in REMOVED_ELEMENTS):
            piece = page[at:end]
            for name, pieces in texts.items():
                if depth[name]:
                    pieces.append(piece)
            if not depth["head"]:
                outside.append(piece)

    tokens, resume = _tokens(page), None
    while token := _next(tokens, resume):
        start, end, closes, name, attributes = token
        text(start)
        at, name, resume = end, name.lower(), None
        if name == "meta" and not closes:
            a = _attributes(attributes)
            metas.append((a.get("property", "").strip() or a.get("name", "").strip(), a.get("content", "")))
        if not closes and name in _RAW_TEXT and not attributes.rstrip().endswith("/"):
            close = _RAW_TEXT[name].search(page, at)
            if name == "textarea":
                text(close.start() if close else len(page))
            at = resume = close.end() if close else len(page)
        elif name in depth:
            if not closes and name not in closed:
                depth[name] += 1
                seen_body |= name == "body"
            elif closes and depth[name]:
                depth[name] -= 1
                if not depth[name] and name in texts:
                    closed.add(name)
    text(len(page))
    if not seen_body:
        texts["body"] = outside
    return [_html.unescape("".join(texts[n])) for n in READABLE_CONTAINERS], metas


@F.arrow_udf(T.ArrayType(T.StringType()))
def page_containers(pages: pa.Array) -> pa.Array:
    return pa.array((_page_parts(p.as_py() or "")[0] for p in pages), pa.list_(pa.string()))


@F.arrow_udf(_METAS)
def page_metas(pages: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
    return pa.array(([{"key": k, "value": v} for k, v in _page_parts(p.as_py() or "", False)[1]] for p in pages), kind)


def readable_text(html) -> Column:
    """Readable text of a page ('' when nothing readable)."""
    containers = page_containers(col_(html))
    cleaned = F.transform(containers, clean_text)
    return F.coalesce(F.try_element_at(F.filter(cleaned, lambda t: t != ""), F.lit(1)), F.lit(""))


def meta_pairs(html) -> Column:
    """``array<struct<key,value>>`` of whitelisted ``<meta>`` tags in page order."""
    pairs = F.transform(page_metas(col_(html)), lambda p: F.struct(
        F.lower(go_trim(p["key"])).alias("key"), go_trim(p["value"]).alias("value")))
    return F.filter(pairs, lambda p: p["key"].isin(*META_KEYS) & (p["value"] != ""))


def meta_value(pairs: Column, key: str) -> Column:
    """Last value of ``key`` (last wins), '' when absent."""
    hits = F.filter(pairs, lambda p: p["key"] == F.lit(key))
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


def page_title(html) -> Column:
    """Trimmed text of the first ``<title>``."""
    # the first <title always matches, to the end of the page if need be: no second try further on
    page = F.coalesce(col_(html), F.lit(""))
    pattern = r"(?is)<title\b[^>]*+(?:>(.*?)(?:(</title\s*+>)|\z)|\z)"
    raw = F.when(F.regexp_extract(page, pattern, 2) != "", F.regexp_extract(page, pattern, 1)).otherwise("")
    return go_trim(html_unescape(raw))
