"""Text helpers as Column expressions."""

from __future__ import annotations

import json
import zlib
from html.entities import html5 as _html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex with UNICODE_CHARACTER_CLASS: \s covers U+00A0, U+3000, ...
# (measured faster than spelling the White_Space set out as a class)
_USPACE = r"(?U)\s+"
NON_WS = r"(?U)\S"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def go_trim(c) -> Column:
    """Trim Unicode white space at both ends.  (The input is referenced once:
    these helpers nest, and a repeated reference would multiply the work.)"""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def clean_text(c) -> Column:
    """Collapse every run of Unicode white space to one space, then trim."""
    return go_trim(F.regexp_replace(col_(c), _USPACE, " "))


def first_non_empty(*cols) -> Column:
    """First value whose trimmed form is non-empty, trimmed; else ''."""
    trimmed = [F.nullif(go_trim(F.coalesce(col_(c), F.lit(""))), F.lit("")) for c in cols]
    return F.coalesce(*trimmed, F.lit(""))


def first_non_blank(*cols) -> Column:
    """First value holding a non-white-space character, untrimmed (callers
    that clean the text anyway skip a full-length trim this way; the test
    stops at the first non-space character)."""
    picks = [F.when(F.coalesce(col_(c), F.lit("")).rlike(NON_WS), col_(c)) for c in cols]
    return F.coalesce(*picks, F.lit(""))


def truncate_runes(c, n: int) -> Column:
    """Cut to n code points; when longer and n > 3, keep n-3 and add '...'."""
    c = col_(c)
    if n <= 3:
        return F.when(F.char_length(c) <= n, c).otherwise(F.substring(c, 1, n))
    return F.when(F.char_length(c) <= n, c).otherwise(
        F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def clean_truncate(c, n: int, prep=None) -> Column:
    """``truncate_runes(clean_text(prep(c)), n)``."""
    c = col_(c)
    return truncate_runes(clean_text(prep(c) if prep else c), n)


def contains_any(text: Column, patterns: list[str]) -> Column:
    """True when any (pre-lowered, non-blank) pattern is a substring."""
    if not patterns:
        return F.lit(False)
    out = None
    for p in patterns:
        e = F.contains(text, F.lit(p))
        out = e if out is None else (out | e)
    return out


def matching_contains(text: Column, patterns: list[str]) -> Column:
    """Array of the patterns (in list order, duplicates kept) found in text."""
    if not patterns:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(text, p))


def keyword_score(text: Column, patterns: list[str]) -> Column:
    """Number of patterns contained in text; repeated patterns count again."""
    if not patterns:
        return F.lit(0)
    return sum((F.contains(text, F.lit(p)).cast("int") for p in patterns), F.lit(0))


def prepare_patterns(patterns) -> list[str]:
    """Trim + lower keyword patterns, dropping blanks (plan-time)."""
    return [p.strip().lower() for p in (patterns or []) if p and p.strip()]


# Named character references of HTML5, from the standard library's table.  Some
# old names also count without the closing semicolon; the longest one is taken.
_OLD_NAMES = sorted((k for k in _html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
# Spark looks through a map from its first key on, so the table is cut into small ones by a checksum of the name.
_NAME_BUCKETS = 1024
# Numeric references 0x80 to 0x9F stand for these characters (Windows-1252).
_C1 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
_NUMBER = r"^#(?:[xX]([0-9a-fA-F]++)|([0-9]++));?"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _named(name: Column) -> Column:
    """The characters of a named reference; null where there is none of that name."""
    buckets = [{} for _ in range(_NAME_BUCKETS)]
    for k, v in _html5.items():
        buckets[zlib.crc32(k.encode()) % _NAME_BUCKETS][k] = v
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    return F.try_element_at(table[(F.crc32(name) % _NAME_BUCKETS).cast("int")], name)


def _code_point(n: Column) -> Column:
    """The character of a number; U+FFFD where there is none."""
    known = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
            .when(n.between(0x80, 0x9F) & (F.substring(F.lit(_C1), (n - 0x7F).cast("int"), F.lit(1)) != "\ufffd"),
                  F.substring(F.lit(_C1), (n - 0x7F).cast("int"), F.lit(1)))
            .otherwise(known))


def _number(reference: Column) -> Column:
    """The number of a numeric reference; one beyond all characters if it is long."""
    digits = lambda group: F.ltrim(F.regexp_extract(reference, _NUMBER, group), F.lit("0"))
    return _bound(F.struct(digits(1).alias("hexa"), digits(2).alias("deci")), lambda d: (
        F.when((F.length(d["hexa"]) > 6) | (F.length(d["deci"]) > 7), F.lit(1 << 21).cast("long"))
        .when(d["hexa"] != "", F.conv(d["hexa"], 16, 10).cast("long")).when(d["deci"] != "", d["deci"].cast("long"))
        .otherwise(F.lit(0).cast("long"))))


def html_unescape(c) -> Column:
    """Decode every HTML character reference, named and numeric, in the JVM.

    The text is split at ``&``; each piece that begins with a reference gets
    its character instead.  Each part of a reference is worked out once."""
    def piece(p: Column) -> Column:
        after = lambda head: F.substring(p, F.length(head) + 1, F.lit((1 << 31) - 1))
        plain = F.concat(F.lit("&"), p)
        numeric = _bound(F.regexp_extract(p, _NUMBER, 0), lambda r: F.when(
            r != "", F.concat(_bound(_number(r), _code_point), after(r))).otherwise(plain))
        old = _bound(F.regexp_extract(p, "^(?:" + "|".join(_OLD_NAMES) + ")", 0), lambda r: F.when(
            r != "", F.concat(_named(r), after(r))).otherwise(plain))
        name = _bound(F.regexp_extract(p, r"^[A-Za-z][A-Za-z0-9]*+;", 0), lambda r: F.struct(
            r.alias("name"), F.when(r != "", _named(r)).alias("char")))
        named = _bound(name, lambda r: F.when(r["char"].isNotNull(), F.concat(r["char"], after(r["name"]))).otherwise(old))
        return F.when(F.startswith(p, F.lit("#")), numeric).otherwise(named)

    def pieces(whole: Column) -> Column:
        return F.array_join(F.transform(F.split(whole, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")

    return _bound(col_(c), lambda x: F.when(F.contains(x, F.lit("&")), pieces(x)).otherwise(x))


def escape_md_link(c) -> Column:
    """Escape ``[`` and ``]`` for Markdown link text."""
    return F.replace(F.replace(col_(c), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def format_score(c) -> Column:
    """Score rendered with 3 fixed decimals."""
    return F.format_string("%.3f", col_(c))


def parse_score(c) -> Column:
    """Numeric score from text, 0 when missing or not a number."""
    return F.coalesce(F.expr("try_cast(null as double)") if c is None else
                      col_(c).try_cast("double"), F.lit(0.0))


def parse_count(c) -> Column:
    """Integer count from text ('' / junk -> 0); strict digits like Atoi."""
    c = col_(c)
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), F.coalesce(c.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0))


def has_count(c) -> Column:
    """Bookmark count is shown only when it is neither '' nor '0'."""
    c = F.coalesce(col_(c), F.lit(""))
    return (c != "") & (c != "0")
