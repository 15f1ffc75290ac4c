"""Secret scans over a trigram inverted index, in SQL expressions only.

Each rule's pattern gives a Boolean query: an OR of sets of trigrams of which a
text must have all of one set to match.  The index holds, for the trigrams that
occur in queries, posting lists of document ids, cut into blocks of ids so that
a list stays bounded however common its trigram is.  A query intersects the
posting lists of each of its sets; the candidates are verified with the pattern.
Rules without mandatory trigrams scan every text."""

from __future__ import annotations

import math
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import saved

IDS_PER_BLOCK = 1 << 16
MOST_STRINGS = 64  # of a pattern's piece that are listed for its trigrams
MOST_CHARACTERS = 8  # of a class that is listed


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    prefilter: str | None = None  # needed for a match; saves splitting texts that have none


# The forms of credentials.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),  # runs are maximal, so shorter ones need no listing
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# --- Boolean trigram queries ------------------------------------------------------------

def _listed(node) -> set[str] | None:
    """The strings a parsed element can match, lower-case; None if too many."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < MOST_CHARACTERS:
                out.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None
        return out if len(out) <= MOST_CHARACTERS else None
    if op is sre.SUBPATTERN:
        return _joined(arg[-1])
    if op is sre.BRANCH:
        parts = [_joined(b) for b in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] == 1:
        once = _joined(arg[2])
        return None if once is None else once | ({""} if arg[0] == 0 else set())
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        listed = _listed(node)
        if listed is None or len(out) * len(listed) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in listed}
    return out


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams; a text that matches has all of one set.
    None if the pattern has no mandatory trigrams."""
    clauses: list[list[frozenset[str]]] = []
    run = {""}

    def close():
        if all(len(s) >= 3 for s in run):
            clauses.append([_grams(s) for s in run])

    for node in sre_parser.parse(pattern):
        listed = _listed(node)
        if listed is not None and len(run) * len(listed) <= MOST_STRINGS:
            run = {a + b for a in run for b in listed}
            continue
        close()
        run = listed if listed is not None else {""}
    close()
    if not clauses:
        return None
    sets = reduce(lambda a, b: [x | y for x in a for y in b], clauses)
    return sorted({s for s in sets if not any(o < s for o in sets)}, key=sorted)


# --- index and search --------------------------------------------------------------------

def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(trigram, block, ids)``: sorted posting lists of ``docs(doc_id, text)``."""
    n_blocks = max(1, math.ceil(docs.count() / IDS_PER_BLOCK))
    present = F.transform(F.array(F.lower("text")), lambda low: F.filter(
        F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))[0]
    return docs.where("doc_id is not null").select("doc_id", F.explode(present).alias("trigram")) \
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))) \
        .groupBy("trigram", "block").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``(doc_id, kinds)``: the rules whose query a document satisfies."""
    asked = [(kind, i, t, len(s)) for kind, sets in queries.items() for i, s in enumerate(sets) for t in sorted(s)]
    asked = index.sparkSession.createDataFrame(asked, "kind string, part int, trigram string, needed int")
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    return index.join(F.broadcast(asked), "trigram").groupBy("kind", "part", "block", "needed") \
        .agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("needed")) \
        .select("kind", F.explode(both).alias("doc_id")).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches as (start, order, kind, end), from the pieces between them; in
    code points, end exclusive."""
    lengths = lambda c: F.transform(c, lambda x: F.length(x).cast("long"))
    parts = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, F.lit(rule.pattern), 0)).alias("all"),
        lengths(F.regexp_extract_all(text, F.lit(rule.pattern), rule.group)).alias("own"))
    span = "struct<start:bigint,kind_order:int,kind:string,end:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(s, x):
        a = s["at"] + x["gap"]
        hit = F.struct(a.alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), (a + x["all"]).alias("end"))
        return F.when(x["all"].isNull(), s).otherwise(F.struct(
            (a + x["all"]).alias("at"),
            F.when(x["own"] >= rule.least, F.concat(s["out"], F.array(hit.cast(span)))).otherwise(s["out"]).alias("out")))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, spans)``, spans sorted by start and
    then by the rules' order, as structs ``(start, kind_order, kind, end)``.

    Matches are leftmost and do not overlap within a rule; those whose group is
    too short are dropped.  Null texts count as empty.  Rows without an id are in
    no posting list and are verified by all rules.  Other columns are ignored."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for sets in queries.values() for s in sets for t in s})
    found = docs
    if trigrams:
        index = saved(trigram_index(docs, trigrams), "trigrams")
        found = docs.join(saved(candidates(index, queries), "candidates"), "doc_id", "left")
    else:
        found = docs.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:bigint,kind_order:int,kind:string,end:bigint>>")
    text = F.col("text")
    per_rule = []
    for i, rule in enumerate(rules):
        tried = F.col("doc_id").isNull() | F.array_contains("kinds", rule.kind) if rule.kind in queries else F.lit(True)
        if rule.prefilter:
            tried = tried & text.rlike(rule.prefilter)
        per_rule.append(F.when(tried, _spans(text, rule, i)).otherwise(none))
    return found.select("doc_id", F.array_sort(F.flatten(F.array(*per_rule))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
