"""Source divergence audit: how differently the sources of a language use its terms.

Every source of a language (a group) has counts of the language's terms, those
in at least ``min_docs`` of its documents.  With smoothing a group gives each of
its language's ``V`` terms the share ``p = 1 + floor(10**9 * (count + 2) / (N +
2 * V))``; two shares of a term differ by ``floor((p - q)**2 / (p + q))``, and two
groups by the sum over all terms.  All of it is exact integer arithmetic.

The terms of a language are dealt by hash into blocks of about
``TERMS_PER_BLOCK``, numbered in each.  A group's counts in a block are one sorted
(term id, count) array of bounded size.  The arrays of two groups meet in a task
per block and pair of *tiles* (a few groups each, so that an array is not sent once
per other group): for each unordered pair the shorter array gallops through the
longer one, which prices the overlap, the terms that only one has, and the terms of
the block that neither has, by the other side's share of an absent term.  The
difference of a pair holds both ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.llm.common import blocks, on_workers, saved, words_of

SCALE = 1_000_000_000
TERMS_PER_BLOCK = 1 << 15
GROUPS_PER_TILE = 16
STRIDE = 64
BLOCK_BYTES = 1 << 22
MAX_BROADCAST_LANGUAGES = 10_000

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[:128] = True
_SEPARATORS[65:91] = _SEPARATORS[97:123] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

COUNTS = "lang string, source string, term string, n_docs long, n long"


# --- counts ---------------------------------------------------------------------------

def _block_terms(block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of a block, and of each occurrence its document and term."""
    words = words_of(block, _SEPARATORS)
    text = _LOWER[block.data][~_SEPARATORS[block.data]]
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    terms = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text.tobytes()))
    coded = terms.dictionary_encode()
    return coded.dictionary, np.repeat(np.arange(len(block)), np.diff(words.first)), coded.indices.to_numpy().astype(np.int64)


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs(lang, source, text)`` -> ``(lang, source, term, n_docs, n)``: terms are
    runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased.  Tasks
    count by block first, so that a common term is a few rows of each task."""
    on_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            known = sorted(set(groups))
            code = {g: i for i, g in enumerate(known)}
            group = np.array([code[g] for g in groups], np.int64)
            for b in blocks(batch.column(2), BLOCK_BYTES):
                terms, doc, term = _block_terms(b)
                if not len(term):
                    continue
                keys, n = np.unique(group[b.lo + doc] * len(terms) + term, return_counts=True)
                once = np.unique(doc * len(terms) + term)
                _, n_docs = np.unique(group[b.lo + once // len(terms)] * len(terms) + once % len(terms), return_counts=True)
                own = keys // len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([known[g][0] for g in own]), pa.array([known[g][1] for g in own]),
                     terms.take(pa.array(keys % len(terms))).cast(pa.string()), pa.array(n_docs), pa.array(n)],
                    ["lang", "source", "term", "n_docs", "n"])

    parts = docs.select("lang", "source", "text").mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def _with_language(df: DataFrame, languages: DataFrame, how: str = "inner") -> DataFrame:
    """Joins a row per language; a broadcast only where there are few."""
    return df.join(F.broadcast(languages) if languages.count() <= MAX_BROADCAST_LANGUAGES else languages, "lang", how)


# --- prices ---------------------------------------------------------------------------

def share(count: str, total: str) -> Column:
    """Smoothed share of a term, ``total`` being ``N + 2 * V``."""
    return F.expr(f"1 + ({SCALE} * (cast({count} as decimal(18, 0)) + 2)) div cast({total} as decimal(18, 0))")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """As ``share``, by long division in digits of base 1000, exact below 2**53."""
    digit, rest = np.divmod(counts.astype(np.int64) + 2, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        digit = digit * 1000 + more
    return digit + 1


def price(p, q):
    return (p - q) * (p - q) // (p + q)


def gallop(keys: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Place of each key of a sorted array in a longer sorted one, -1 if absent.
    Every ``STRIDE``-th key is searched; the others gallop on from there, in steps
    that double until they pass the key, and halve the last step."""
    n = len(within)
    if not len(keys) or not n:
        return np.full(len(keys), -1)
    low = np.repeat(np.searchsorted(within, keys[::STRIDE]), STRIDE)[:len(keys)]
    high, step, todo = low.copy(), 1, np.flatnonzero(within[np.minimum(low, n - 1)] < keys)
    while len(todo):
        low[todo] = high[todo]
        high[todo] = np.minimum(high[todo] + step, n)
        todo, step = todo[(high[todo] < n) & (within[np.minimum(high[todo], n - 1)] < keys[todo])], step * 2
    while (open_ := high - low > 0).any():
        middle = (low + high) // 2
        less = open_ & (within[np.minimum(middle, n - 1)] < keys)
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    found = within[np.minimum(low, n - 1)] == keys
    return np.where(found, low, -1)


def pair_price(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], n_terms: int) -> int:
    """Difference of two groups over a block of ``n_terms`` terms.  A side is its
    sorted term ids, their shares, and its share of an absent term."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids_a, p_a, none_a), (ids_b, p_b, none_b) = a, b
    at = gallop(ids_a, ids_b)
    met = at >= 0
    alone = np.ones(len(ids_b), bool)
    alone[at[met]] = False
    neither = n_terms - len(ids_a) - int(alone.sum())
    return int(price(p_a[met], p_b[at[met]]).sum() + price(p_a[~met], none_b).sum()
               + price(p_b[alone], none_a).sum()) + neither * int(price(none_a, none_b))


# --- the audit --------------------------------------------------------------------------

def _pair_values(sides: DataFrame) -> DataFrame:
    """``sides(lang, source, bucket, tile, tiles, total, n_terms, ids, counts)`` ->
    ``(lang, a, b, value)`` of all pairs with ``a < b``, summed over buckets."""
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = sides.select("*", other).select(
        "lang", "bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        "source", "tile", "total", "n_terms", "ids", "counts")

    def meet(key, table):
        lang, _, low, high = (k.as_py() for k in key)
        source, tile = table.column("source").to_pylist(), table.column("tile").to_numpy()
        n_terms, total = table.column("n_terms")[0].as_py(), table.column("total").to_pylist()
        side = []
        for i in range(table.num_rows if n_terms else 0):
            ids, counts = (table.column(c)[i].values for c in ("ids", "counts"))
            ids, counts = (np.empty(0, np.int64) if x is None else x.to_numpy() for x in (ids, counts))
            side.append((ids, shares(counts, total[i]), int(shares(np.zeros(1, np.int64), total[i])[0])))
        out = []
        for i in np.flatnonzero(tile == low):
            for j in np.flatnonzero(tile == high):
                if low < high or source[i] < source[j]:
                    a, b = sorted((source[i], source[j]))
                    out.append((a, b, pair_price(side[i], side[j], n_terms) if n_terms else 0))
        a, b, value = zip(*out) if out else ((), (), ())
        return pa.table([pa.array([lang] * len(out), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()),
                         pa.array(value, pa.int64())], ["lang", "a", "b", "value"])

    return dealt.groupBy("lang", "bucket", "low", "high").applyInArrow(meet, "lang string, a string, b string, value long") \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, terms_per_block: int = TERMS_PER_BLOCK,
          groups_per_tile: int = GROUPS_PER_TILE) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs(lang, source, text)``.

    Part ``pair``: for every group each other source of its language and the
    difference of the two, all ranks.  Part ``term``: the group's ``top`` terms
    that it uses more than its language does (share above the language's), by the
    difference of these two shares.  Ranks run from 1 by falling value, then by
    item in UTF-8 order.  Null text, lang and source count as empty ones; rows are
    documents, repeated ones too; groups without terms have pairs, a language
    without kept terms has value 0 for all of them.  An empty table gives no rows,
    other columns are ignored."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = saved(term_counts(docs), "term-counts")
    terms = saved(counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
                  .where(F.col("n_docs") >= min_docs).select("lang", "term", "n"), "terms")
    languages = saved(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n")), "languages")
    bucket = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / terms_per_block).cast("long")).cast("int")
    terms = _with_language(terms, languages).select("lang", "term", "n", "v", "lang_n", bucket.alias("bucket"))
    number = F.row_number().over(W.partitionBy("lang", "bucket").orderBy("term")).cast("long")
    terms = saved(terms.withColumn("id", number), "numbered-terms")
    entries = saved(counts.select("lang", "source", "term", "n").join(
        terms.select("lang", "term", "bucket", "id", F.col("n").alias("lang_term_n"), "v", "lang_n"), ["lang", "term"]), "entries")
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left")
    groups = saved(_with_language(groups, languages, "left").select(
        "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("own_n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("total")),
        "groups")

    tiles = F.ceil(F.count("*") / groups_per_tile).cast("int")
    per_language = groups.groupBy("lang").agg(tiles.alias("tiles"))
    last = F.greatest(F.lit(1), F.ceil(F.col("v") / terms_per_block)).cast("int") - 1
    every = _with_language(groups, saved(per_language, "tiles")).select(
        "lang", "source", "total", "tiles", F.pmod(F.xxhash64("source"), F.col("tiles").cast("long")).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), last)).alias("bucket"))
    arrays = entries.groupBy("lang", "source", "bucket").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("own"))
    sizes = terms.groupBy("lang", "bucket").agg(F.count("*").alias("n_terms"))
    sides = every.join(arrays, ["lang", "source", "bucket"], "left").join(sizes, ["lang", "bucket"], "left") \
        .select("lang", "source", "bucket", "tile", "tiles", "total", F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
                F.col("own.id").alias("ids"), F.col("own.n").alias("counts"))
    pairs = saved(_pair_values(saved(sides, "sides")), "pair-values")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value") \
        .union(pairs.select("lang", F.col("b").alias("source"), F.lit("pair"), F.col("a"), "value"))

    priced = entries.join(groups.select("lang", "source", "total"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share("n", "total").alias("p"),
        share("lang_term_n", "lang_n + 2 * v").alias("q")).where("p > q")
    used = priced.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(used.withColumn("rank", rank).where(F.col("rank") <= top))
