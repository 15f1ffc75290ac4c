"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

# RE2 and Python read this class alike: anything but ASCII white space.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(len(ws) - 49)) AS s, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, s, sha256(array_to_string(ws[s + 1:s + 50], ' ')) AS h FROM win),
f AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
hit AS (SELECT h.doc_id, h.s FROM h JOIN f USING (h) WHERE f.lo < h.doc_id),
gone AS (SELECT DISTINCT doc_id, s + k AS pos FROM hit, range(50) t(k)),
g AS (SELECT doc_id, list(pos) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, ws, len(coalesce(ps, [])) AS n_removed,
    CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i - 1)) END AS ks
  FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""

_OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
si AS (SELECT DISTINCT item_id, least(5, len(ws)) AS k,
         unnest(list_transform(range(len(ws) - least(5, len(ws)) + 1), lambda s: array_to_string(ws[s + 1:s + least(5, len(ws))], ' '))) AS g
       FROM i WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n FROM si GROUP BY item_id),
sd AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(greatest(0, len(ws) - k + 1)), lambda s: array_to_string(ws[s + 1:s + k], ' '))) AS g
       FROM d, (SELECT DISTINCT k FROM si)),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM sd JOIN si USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, n AS item_shingles, shared / n AS containment FROM m JOIN n USING (item_id)
WHERE shared >= 0.8 * n
"""

# Kind, order, pattern, group and least length; written out again, not taken from the engine.
_OP5_KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
               r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("stripe", r"sk_live_[A-Za-z0-9]{24,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
]
_OP5_SCANS = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS k, '{kind}' AS kind,
    [length(x) FOR x IN string_split_regex(text, '{pattern}')] AS gaps,
    [length(x) FOR x IN regexp_extract_all(text, '{pattern}', 0)] AS alls,
    [length(x) FOR x IN regexp_extract_all(text, '{pattern}', {group})] AS owns, {least} AS least FROM d"""
    for i, (kind, pattern, group, least) in enumerate(_OP5_KINDS))
_OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
scans AS ({_OP5_SCANS}),
each AS (SELECT doc_id, k, kind, least, unnest(range(1, len(alls) + 1)) AS i, unnest(alls) AS own_all,
           unnest(owns) AS own, unnest(gaps[1:len(alls)]) AS gap FROM scans WHERE len(alls) > 0),
placed AS (SELECT *, sum(gap + own_all) OVER (PARTITION BY doc_id, k ORDER BY i)::BIGINT AS stop FROM each),
s AS (SELECT doc_id, k, kind, stop - own_all AS start, concat(kind, ':', stop - own_all, ':', stop) AS span
      FROM placed WHERE own >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

_OP6 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)
"""

# The checksum's byte table is made by its rule; keys jump in a recursive query.
_OP7 = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
bytes AS (SELECT doc_id, octet_length(encode(text)) + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS bs FROM raw),
sums AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bs),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, tab),
jump(doc_id, n, key, b, j) AS (
  SELECT DISTINCT doc_id, n, CASE WHEN doc_id < 0 THEN 18446744073709551616 + doc_id::HUGEINT ELSE doc_id::HUGEINT END,
    -1::BIGINT, 0::BIGINT FROM documents, (VALUES (40), (41)) v(n)
  UNION ALL
  SELECT doc_id, n, k2, j, floor((j + 1) * (2147483648::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jump WHERE j < n)),
put AS (SELECT doc_id, max(b) FILTER (n = 40)::INT AS shard, max(b) FILTER (n = 41)::INT AS grown_shard
        FROM jump WHERE j >= n GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM sums JOIN put USING (doc_id)
"""

_OP8 = r"""
WITH docs AS (SELECT doc_id, text, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS ls FROM documents),
l0 AS (SELECT DISTINCT doc_id, unnest(ls) AS line FROM docs),
l1 AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ts FROM l0),
l2 AS (SELECT doc_id, line, array_to_string(ts, ' ') AS words,
         list_transform(ts, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS ts
       FROM l1 WHERE len(ts) >= 1),
l3 AS (SELECT *, concat(len(ts), ' ', CASE WHEN len(ts) < 3 THEN words ELSE array_to_string(ts[1:3], ' ') END) AS leaf FROM l2),
leaves AS (SELECT leaf FROM l3 GROUP BY leaf HAVING count(DISTINCT doc_id) >= 20),
l4 AS (SELECT * FROM l3 SEMI JOIN leaves USING (leaf)),
kinds AS (SELECT leaf, line, any_value(ts) AS ts, count(*) AS n FROM l4 WHERE len(ts) >= 3 GROUP BY leaf, line),
tok AS (SELECT leaf, line, n, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM kinds),
keep AS (SELECT leaf, pos, token FROM tok GROUP BY ALL HAVING sum(n) >= 20 OR token = '<*>'),
named AS (SELECT t.leaf, t.line,
    string_agg(CASE WHEN k.token IS NULL THEN '<*>' ELSE t.token END, ' ' ORDER BY t.pos) AS template
  FROM tok t LEFT JOIN keep k ON t.leaf = k.leaf AND t.pos = k.pos AND t.token = k.token GROUP BY t.leaf, t.line
  HAVING avg(CASE WHEN k.token IS NULL THEN 0.0 ELSE 1.0 END) >= 0.8
     AND avg(CASE WHEN k.token IS NULL OR t.token = '<*>' THEN 0.0 ELSE 1.0 END) >= 0.5
  UNION ALL SELECT DISTINCT leaf, line, leaf FROM l4 WHERE len(ts) < 3),
lines AS (SELECT l4.doc_id, leaf, line, template FROM l4 JOIN named USING (leaf, line)),
recurring AS (SELECT leaf, template, min(doc_id) AS first_doc FROM lines GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 20),
copied AS (SELECT words, min(doc_id) AS first_doc FROM l2 WHERE len(ts) >= 8 GROUP BY words HAVING count(DISTINCT doc_id) >= 2),
later AS (SELECT doc_id, line FROM lines JOIN recurring USING (leaf, template) WHERE doc_id <> first_doc
  UNION ALL SELECT doc_id, line FROM l2 JOIN copied USING (words) WHERE doc_id <> first_doc),
drops AS (SELECT doc_id, list(DISTINCT line) AS gone FROM later GROUP BY doc_id),
cut AS (SELECT d.doc_id, ls, CASE WHEN gone IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(gone, x)) END AS kept
        FROM docs d LEFT JOIN drops USING (doc_id))
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - len(kept))::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM cut
"""

_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
tok AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cnt USING (lang, source)
        GROUP BY lang, source),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (t.n + 2 * l.v) AS p,
    1 + 1000000000 * (k.n + 2)::HUGEINT // (l.n + 2 * l.v) AS q
  FROM tot t JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN cnt c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT t.lang, t.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM tot t JOIN tot o ON t.lang = o.lang AND t.source <> o.source
  LEFT JOIN pairs x ON x.lang = t.lang AND x.source = t.source AND x.item = o.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# The checksum's byte table by its rule, as in _OP7; a node is named by the digests of its turns.
_OP12 = """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
h AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 6 AS h FROM n, tab),
convs AS (SELECT h.c, base, h, least(h, coalesce(n.n, 0)) AS given FROM h LEFT JOIN n ON n.c = base),
r AS (SELECT convs.c, p AS depth, role, text FROM convs JOIN t ON t.c = base WHERE p <= h
  UNION ALL SELECT convs.c, p - h + given, role, text FROM convs JOIN t USING (c) WHERE p > h),
m AS (SELECT c, 0 AS depth, '' AS k, 0 AS w FROM convs
  UNION ALL SELECT c, depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY depth), length(text) FROM r),
size AS (SELECT c, max(depth) AS length FROM m GROUP BY c),
nodes AS (SELECT k, depth, min(c) AS conv_id, count(*) AS n, any_value(w) AS w,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (length = depth), '') AS ends FROM m JOIN size USING (c) GROUP BY k, depth),
kids AS (SELECT substr(k, 1, 64 * (depth - 1)) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT substr(x.k, 1, 64 * d) AS k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * w) AS kept
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM nodes) x LEFT JOIN kids ON kids.k = x.k GROUP BY 1)
SELECT x.conv_id, x.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0) AS n_children,
  leaves::BIGINT AS n_leaves, kept::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN below USING (k) LEFT JOIN kids ON kids.k = x.k
  LEFT JOIN nodes up ON x.depth > 0 AND up.depth = x.depth - 1 AND up.k = substr(x.k, 1, 64 * (x.depth - 1))
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": _OP1,
    "op3_decontamination": _OP3,
    "op5_secret_scan": _OP5,
    "op6_warc": _OP6,
    "op7_sharding": _OP7,
    "op8_line_dedup": _OP8,
    "op11_divergence": _OP11,
    "op12_prefix_trie": _OP12,
}
