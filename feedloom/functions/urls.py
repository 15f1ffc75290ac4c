"""URL normalization (dedup key) and domain extraction as Column expressions.

Rule (the reference's dedup key):
trim; '' stays ''; a URL that does not parse as ``scheme://host...`` is
returned trimmed and unchanged.  Otherwise: lower-case scheme and host, drop
the fragment, drop query keys ``fbclid``/``gclid``/``utm_*`` (case-insensitive),
re-encode the remaining pairs sorted by key (values of one key keep their
order), strip one leading ``m.`` from the host, strip a trailing ``/amp/``
then ``/amp`` from the path, and unless the path is exactly ``/`` strip all
trailing slashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col_, go_trim

_URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?(#.*)?$"
# ASCII characters a host may not contain, and control characters anywhere.
_BAD_HOST = r"[\x00-\x20\x7f{}|\\^`]"
_BAD_ANY = r"[\x00-\x1f\x7f]"
# Path characters that are kept verbatim; everything else is %-encoded.
_PATH_OK = r"[A-Za-z0-9\-._~!$&'()*+,;=:@\[\]/%]"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"


def _query_escape(c: Column) -> Column:
    # url_encode is Java's form encoding: fix the two characters where it
    # differs from query-component escaping ('~' kept, '*' escaped).
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalized_query(q) -> Column:
    """Drop tracking keys and re-encode the query sorted by decoded key."""
    q = col_(q)
    pairs = F.filter(F.split(q, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    decoded = F.transform(pairs, lambda p, i: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
        i.alias("i"),
        F.try_url_decode(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1))
                         .otherwise(F.lit(""))).alias("v")))
    kept = F.filter(decoded, lambda s: s["k"].isNotNull() & s["v"].isNotNull()
                    & ~F.lower(s["k"]).isin("fbclid", "gclid")
                    & ~F.startswith(F.lower(s["k"]), F.lit("utm_")))
    return F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(
        _query_escape(s["k"]), F.lit("="), _query_escape(s["v"]))), "&")


def _escape_path(path: Column) -> Column:
    chars = F.split(path, "")
    enc = F.transform(chars, lambda ch: F.when(ch.rlike("^" + _PATH_OK + "$"), ch).otherwise(
        F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))))
    return F.when(path.rlike("[^" + _PATH_OK[1:]), F.array_join(enc, "")).otherwise(path)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it for ``body`` (a one-element
    ``transform``): Catalyst does not share subexpressions that sit inside
    conditional branches or lambdas, so heavy inputs are bound instead."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stage_parts(raw: Column) -> Column:
    """One regexp pass per URL component."""
    return F.struct(
        raw.alias("raw"),
        raw.rlike(_URL_RE).alias("m"),
        F.regexp_extract(raw, _URL_RE, 1).alias("scheme"),
        F.regexp_extract(raw, _URL_RE, 2).alias("auth"),
        F.regexp_extract(raw, _URL_RE, 3).alias("path"),
        (F.regexp_extract(raw, _URL_RE, 4) != "").alias("has_q"),
        F.regexp_extract(raw, _URL_RE, 5).alias("query"),
        F.regexp_extract(raw, _URL_RE, 6).alias("frag"),
    )


def _stage_fields(p: Column) -> Column:
    """Normalized fields from the parts struct ``p``."""
    raw, auth, path, query = p["raw"], p["auth"], p["path"], p["query"]
    at = F.instr(F.reverse(auth), "@")
    userinfo = F.when(at > 0, F.substring(auth, 1, F.length(auth) - at + 1)).otherwise(F.lit(""))
    hostport = F.substring_index(auth, "@", -1)
    host = F.lower(hostport)
    host = F.when(F.startswith(host, F.lit("m.")), F.substr(host, F.lit(3))).otherwise(host)
    stripped = F.regexp_replace(F.regexp_replace(path, "/amp/$", ""), "/amp$", "")
    port_ok = F.when(F.startswith(hostport, F.lit("[")), hostport.rlike(r"^\[[^\]]*\](:[0-9]*)?$")).otherwise(
        ~hostport.rlike(r":[^:]*[^0-9:][^:]*$"))
    # escapes are validated in host, path and fragment (the query is split
    # into pairs later and a bad pair is dropped there)
    bad_escape = auth.rlike(_BAD_ESCAPE) | path.rlike(_BAD_ESCAPE) | p["frag"].rlike(_BAD_ESCAPE)
    parsed = (p["m"] & (auth != "") & ~raw.rlike(_BAD_ANY) & ~auth.rlike(_BAD_HOST) & ~bad_escape & port_ok)
    return F.struct(
        raw.alias("raw"), parsed.alias("parsed"), F.lower(p["scheme"]).alias("scheme"),
        userinfo.alias("userinfo"), host.alias("host"), stripped.alias("path"),
        normalized_query(query).alias("nq"), (p["has_q"] & (query == "")).alias("force_q"))


def _assemble(f: Column) -> Column:
    path = F.when(f["path"] == "/", f["path"]).otherwise(F.regexp_replace(f["path"], "/+$", ""))
    q_part = F.when(f["nq"] != "", F.concat(F.lit("?"), f["nq"])).when(f["force_q"], F.lit("?")).otherwise(F.lit(""))
    rebuilt = F.concat(f["scheme"], F.lit("://"), f["userinfo"], f["host"], _escape_path(path), q_part)
    return F.when(f["raw"] == "", F.lit("")).when(f["parsed"], rebuilt).otherwise(f["raw"])


def _raw(c) -> Column:
    return go_trim(F.coalesce(col_(c), F.lit("")))


def normalize_url(c) -> Column:
    """Normalized dedup key of a raw link ('' for blank input).

    Column form for ad-hoc use; operators use :func:`with_normalized`,
    which stages the same steps as projections (whole-stage codegen)."""
    return _let(_stage_parts(_raw(c)), lambda p: _let(_stage_fields(p), _assemble))


_STAGE_CACHE: dict = {}


def _staged(df: DataFrame):
    """The three stage expressions over the fixed helper columns, built once
    per Spark application (they only name columns, so they can be reused;
    building them costs hundreds of driver round trips)."""
    key = df.sparkSession.sparkContext.applicationId
    if key not in _STAGE_CACHE:
        _STAGE_CACHE.clear()
        _STAGE_CACHE[key] = (_stage_parts(F.col("_urlr")), _stage_fields(F.col("_urlp")),
                             _assemble(F.col("_urlf")))
    return _STAGE_CACHE[key]


def with_normalized(df: DataFrame, src, out: str) -> DataFrame:
    """Add column ``out`` = normalize(src), one regexp pass per component."""
    parts, fields, assemble = _staged(df)
    df = df.withColumn("_urlr", _raw(src))
    df = df.withColumn("_urlp", parts)
    df = df.withColumn("_urlf", fields)
    return df.withColumn(out, assemble).drop("_urlr", "_urlp", "_urlf")


def with_key(df: DataFrame, out: str = "_key", normalized_col: str = "normalized_url",
             url_col: str = "url") -> DataFrame:
    """Add the dedup key: normalized_url, else normalize(url), else url.
    The URL is only normalized for rows whose normalized_url is empty."""
    n = F.coalesce(F.col(normalized_col), F.lit("")) if normalized_col in df.columns else F.lit("")
    u = F.coalesce(F.col(url_col), F.lit(""))
    df = with_normalized(df, F.when(n == "", u).otherwise(F.lit("")), "_knu")
    return df.withColumn(out, F.when(n != "", n).when(F.col("_knu") != "", F.col("_knu")).otherwise(u)).drop("_knu")


def with_domain(df: DataFrame, out: str = "_domain", normalized_col: str = "normalized_url",
                url_col: str = "url") -> DataFrame:
    """Add the item's domain (host of normalized_url, else of normalize(url),
    without port and one leading www.)."""
    n = F.coalesce(F.col(normalized_col), F.lit("")) if normalized_col in df.columns else F.lit("")
    df = with_normalized(df, F.when(n == "", F.col(url_col)).otherwise(F.lit("")), "_dnu")
    src = F.when(n != "", n).otherwise(F.col("_dnu"))
    return df.withColumn(out, F.regexp_replace(url_host(src), r"^www\.", "")).drop("_dnu")


def dedup_key(normalized_url, url) -> Column:
    """normalized_url, else normalize(url), else url."""
    n = F.coalesce(col_(normalized_url), F.lit(""))
    u = F.coalesce(col_(url), F.lit(""))
    return F.when(n != "", n).otherwise(_let(normalize_url(u), lambda k: F.when(k != "", k).otherwise(u)))


def url_host(c) -> Column:
    """Host name of a URL (no user info, no port, lower case); '' if none."""
    authority = F.regexp_extract(F.coalesce(col_(c), F.lit("")), _URL_RE, 2)

    def body(a):
        hostport = F.substring_index(a, "@", -1)
        host = F.when(F.startswith(hostport, F.lit("[")),
                      F.regexp_extract(hostport, r"^\[([^\]]*)\]", 1)).otherwise(
            F.regexp_replace(hostport, r":[0-9]*$", ""))
        return F.lower(host)
    return _let(authority, body)


def item_domain(normalized_url, url=None) -> Column:
    """Domain of an item: host of its normalized URL minus one leading www."""
    if url is None:
        src = col_(normalized_url)
    else:
        n = F.coalesce(col_(normalized_url), F.lit(""))
        src = F.when(n != "", n).otherwise(normalize_url(url))
    return F.regexp_replace(url_host(src), r"^www\.", "")


def domain_suffixes(domain) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: the strings that an equal-or-dotted-suffix
    match can hit, so list matching becomes ``arrays_overlap`` or an equi-join."""
    parts = F.split(col_(domain), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def normalize_domain_list(domains) -> list[str]:
    """Lower, trim, strip one leading www., drop blanks (plan-time)."""
    out = []
    for d in domains or []:
        d = (d or "").strip().lower()
        if d.startswith("www."):
            d = d[4:]
        if d:
            out.append(d)
    return out


def domain_matches(domain: Column, patterns: list[str]) -> Column:
    """Equal to a pattern or ending with '.' + pattern."""
    if not patterns:
        return F.lit(False)
    return F.arrays_overlap(domain_suffixes(domain), F.array(*[F.lit(p) for p in patterns]))


def archive_key(link) -> Column:
    """Archive partition key: the feed link without every http(s)://."""
    return F.regexp_replace(col_(link), r"http(s*)://", "")
