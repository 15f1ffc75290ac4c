"""Language identification with interpolated Kneser-Ney character models.

One model per language, of ``ORDER`` characters.  The n-grams of all languages
lie in one sorted array of hashes per order, with a row of log-probabilities
(one per language); contexts have another, with their back-off weights.  A text
gets the language of the lowest cross-entropy per character.  It is rejected
when even that is higher than what the language's own texts of its length have.

Training uses a bounded sample: about ``per_language`` labelled rows of each
language, chosen by a hash of doc_id; a quarter of it calibrates the rejection.
Each letter of the sample is a symbol of its own; if it has more than ``ALPHABET``
different ones (4,091, so only beyond alphabets), the rarest share one.
The n-gram counts of the sample are summed by Spark; the model is built from
the counts and broadcast, its size bounded by the sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import blocks, mix, on_workers, saved

ORDER = 5
EDGE, SPACE, DIGIT, SIGN, LETTER = range(5)  # symbols below those of the alphabet
SYMBOL_BITS = 12   # ORDER symbols fill 60 bits of a key
ALPHABET = (1 << SYMBOL_BITS) - LETTER - 1
UNKNOWN = "und"
MAX_BROADCAST_LANGUAGES = 10_000


# --- characters to symbols ------------------------------------------------------------

def symbol_table(letters: list[str]) -> np.ndarray:
    """Symbol of each code point: letters by their lower-case form."""
    known = {c: LETTER + 1 + i for i, c in enumerate(letters)}
    table = np.full(0x110000, SIGN, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = known.get(c.lower(), LETTER)
        elif c.isspace():
            table[cp] = SPACE
        elif c.isdigit():
            table[cp] = DIGIT
    return table


def _code_points(block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and where its documents begin among them."""
    cps = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    return cps, at[block.offsets]


def _grams(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ``ORDER`` symbols that end at each position, packed ``SYMBOL_BITS`` each, with
    EDGE before a document's first character."""
    n_docs = len(first) - 1
    pad = ORDER - 1
    counts = np.diff(first)
    padded = np.zeros(len(symbols) + pad * n_docs, np.uint64)
    at = np.arange(len(symbols)) + pad * (np.repeat(np.arange(n_docs), counts) + 1)
    padded[at] = symbols
    packed = padded.copy()
    for back in range(1, ORDER):
        packed[back:] |= padded[:-back] << np.uint64(SYMBOL_BITS * back)
    return packed[at]


# --- the model ------------------------------------------------------------------------

def _hashed(keys: np.ndarray, order: int) -> np.ndarray:
    return mix(keys | np.uint64(order << (SYMBOL_BITS * ORDER)))


class SortedTable:
    """Values by hash: a sorted array of hashes, and where each leading-bits
    group of it begins."""

    def __init__(self, keys: np.ndarray, order: int, values: np.ndarray):
        h = _hashed(keys, order)
        by = np.argsort(h)
        self.order, self.h, self.values = order, np.append(h[by], np.uint64(2**64 - 1)), values[by]
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        heads = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.head = np.searchsorted(h[by], heads).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if absent."""
        h = _hashed(keys, self.order)
        at = self.head[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        have = self.h[at]
        todo = np.flatnonzero(have < h)
        while len(todo):
            at[todo] += 1
            have[todo] = self.h[at[todo]]
            todo = todo[have[todo] < h[todo]]
        return np.where((have == h) & (at < len(self.values)), at, -1)


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray
    grams: list[SortedTable]      # by order - 1
    contexts: list[SortedTable]   # by order - 1; log back-off weights
    unseen: float                 # log-probability of a symbol in no table
    limits: np.ndarray            # per language: center, spread, spread of one character

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """A row of per-language log-probabilities per packed n-gram."""
        out = np.zeros((len(packed), len(self.languages)), np.float32)
        todo, keys = np.arange(len(packed)), packed
        for order in range(ORDER, 0, -1):
            row = self.grams[order - 1].find(keys)
            hit = row >= 0
            if hit.all() and len(todo) == len(packed):
                return self.grams[order - 1].values[row]
            out[todo[hit]] += self.grams[order - 1].values[row[hit]]
            todo, keys = todo[~hit], keys[~hit]
            if not len(todo):
                return out
            row = self.contexts[order - 1].find(keys >> np.uint64(SYMBOL_BITS))
            seen = row >= 0
            out[todo[seen]] += self.contexts[order - 1].values[row[seen]]
            keys = keys & np.uint64((1 << (SYMBOL_BITS * (order - 1))) - 1)
        out[todo] += np.float32(self.unseen)
        return out

    def entropies(self, block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per document: characters, letters, cross-entropy per language, and the
        spread of one character's share under the best language."""
        cps, first = _code_points(block)
        symbols = self.symbols[cps]
        lp = self.log_probabilities(_grams(symbols, first))
        sums = np.zeros((len(cps) + 1, lp.shape[1]))
        np.cumsum(lp, axis=0, out=sums[1:])
        n = np.diff(first)
        total = sums[first[1:]] - sums[first[:-1]]
        entropy = -total / np.maximum(n, 1)[:, None]
        letters = np.concatenate([[0], np.cumsum(symbols >= LETTER)])
        return n, letters[first[1:]] - letters[first[:-1]], entropy, lp


def _lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Row of each key in ``sorted_keys``; -1 if absent."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], symbols: np.ndarray) -> Model:
    """Model from each language's packed n-grams and counts."""
    languages = sorted(counts)
    n_lang, vocabulary = len(languages), max(1, len(np.unique(symbols)))
    grams, contexts = [], []
    # per order and language: n-grams with (continuation) counts
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for lang in languages:
        keys, n = counts[lang]
        levels[ORDER - 1].append((keys, n.astype(float)))
        for order in range(ORDER - 1, 0, -1):
            shorter, n = np.unique(keys & np.uint64((1 << (SYMBOL_BITS * order)) - 1), return_counts=True)
            levels[order - 1].append((shorter, n.astype(float)))
            keys = shorter
    lower_keys, lower_p = np.zeros(1, np.uint64), np.full((1, n_lang), 1.0 / vocabulary)
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([k for k, _ in levels[order - 1]]))
        p = np.empty((len(union), n_lang))
        context = union >> np.uint64(SYMBOL_BITS)
        union_contexts = np.unique(context)
        weight = np.ones((len(union_contexts), n_lang))
        suffix = union & np.uint64((1 << (SYMBOL_BITS * (order - 1))) - 1)
        below = lower_p[np.searchsorted(lower_keys, suffix)]
        for i, (keys, n) in enumerate(levels[order - 1]):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            own, where = np.unique(keys >> np.uint64(SYMBOL_BITS), return_inverse=True)
            total, kinds = np.bincount(where, n), np.bincount(where)
            gamma = discount * kinds / total
            row = np.searchsorted(union_contexts, own)
            weight[row, i] = gamma
            at = _lookup(keys, union)
            p[:, i] = weight[np.searchsorted(union_contexts, context), i] * below[:, i]
            p[at, i] += (n - discount).clip(0) / total[where]
        grams.append(SortedTable(union, order, np.log(p).astype(np.float32)))
        contexts.append(SortedTable(union_contexts, order, np.log(weight).astype(np.float32)))
        lower_keys, lower_p = union, p
    return Model(languages, symbols, grams, contexts, float(np.log(1.0 / vocabulary)), np.zeros((n_lang, 3)))


# --- training -------------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 400) -> Model | None:
    """Learn from the rows of ``docs(doc_id, text, lang)`` that are labelled, have
    an id and are not held out.  None if there are none."""
    spark = docs.sparkSession
    on_workers(spark)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
                      & ~held_out(F.col("doc_id")))
    share = saved(rows.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("share")), "shares")
    if share.count() <= MAX_BROADCAST_LANGUAGES:  # else a plain join
        share = F.broadcast(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = saved(rows.join(share, "lang").where(draw < F.col("share") * (1 << 30))
                   .select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("calibrate")),
                   "language-sample")
    letters = [r[0] for r in sample.where(~F.col("calibrate"))
               .select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L})"), 1)).alias("c"))
               .groupBy("c").count().orderBy(F.desc("count"), "c").limit(ALPHABET).collect()]
    symbols = symbol_table([c for c in letters if len(c) == 1])

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for b in blocks(batch.column(1)):
                cps, first = _code_points(b)
                packed = _grams(symbols[cps], first)
                whose = np.repeat(langs[b.lo:b.hi], np.diff(first))
                for lang in set(langs[b.lo:b.hi]):
                    keys, n = np.unique(packed[whose == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                        ["lang", "gram", "n"])

    table = sample.where(~F.col("calibrate")).select("lang", "text").mapInArrow(count, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, own in table.groupby("lang"):
        own = own.sort_values("gram")
        counts[lang] = (own["gram"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy())
    if not counts:
        return None
    model = kneser_ney(counts, symbols)
    model.limits = _calibrate(sample.where("calibrate"), model)
    return model


def _calibrate(sample: DataFrame, model: Model) -> np.ndarray:
    """Center and spread of the cross-entropy that a language's own texts have,
    and the spread of single characters (robust: medians)."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for b in blocks(batch.column(1)):
                m = shared.value
                n, letters, entropy, lp = m.entropies(b)
                first = np.concatenate([[0], np.cumsum(n)])
                rows = []
                for d in range(len(b)):
                    if langs[b.lo + d] in m.languages and letters[d]:
                        i = m.languages.index(langs[b.lo + d])
                        own = lp[first[d]:first[d + 1], i]
                        rows.append((i, int(n[d]), float(entropy[d, i]), float(own.std())))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["i", "n", "entropy", "sd"]).astype(
                    {"i": "int64", "n": "int64", "entropy": "float64", "sd": "float64"}), preserve_index=False)

    got = sample.select("lang", "text").mapInArrow(run, "i long, n long, entropy double, sd double").toPandas()
    pooled = got.assign(i=-1)
    out = np.zeros((len(model.languages), 3))
    for i in range(len(model.languages)):
        own = got[got["i"] == i]
        own = pooled if len(own) < 5 else own
        if len(own):
            center = own["entropy"].median()
            out[i] = center, 1.4826 * (own["entropy"] - center).abs().median(), own["sd"].median()
        else:
            out[i] = np.inf, 0, 0
    return out


# --- prediction -----------------------------------------------------------------------

RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


def identify(docs: DataFrame, model: Model | None, tolerance: float = 12.0, slack: float = 0.25,
             sharpness: float = 8.0) -> DataFrame:
    """``docs`` as a struct column ``row``, with ``lang_pred``, ``score``,
    ``cross_entropy`` (nats per character) and ``rejected``.

    ``score`` is the softmax of the negative cross-entropies times ``sharpness``.
    A text is rejected if it has no letter (``und``, score 0, null cross-entropy)
    or if its cross-entropy exceeds center + slack + tolerance times the spread
    that its predicted language's calibration texts show for its length.  Equal
    cross-entropies go to the first language by name."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    packed = docs.withColumn("text", F.col("text").cast("string")).select(F.struct("*").alias("row"))
    row_type = packed.schema["row"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            for b in blocks(batch.column(0).field("text")):
                k = len(b)
                langs, score = np.full(k, UNKNOWN, object), np.zeros(k)
                value, bad = np.full(k, np.nan), np.ones(k, bool)
                if m is not None:
                    n, letters, entropy, _ = m.entropies(b)
                    best = entropy.argmin(1)
                    low = entropy[np.arange(k), best]
                    soft = 1 / np.exp((low[:, None] - entropy) * sharpness).sum(1)
                    center, spread, single = m.limits[best].T
                    limit = center + slack + tolerance * np.sqrt(spread**2 + single**2 / np.maximum(n, 1))
                    ok = letters > 0
                    langs[ok] = np.array(m.languages, object)[best[ok]]
                    score[ok], value[ok] = soft[ok], low[ok]
                    bad = ~ok | (low > limit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, k), pa.array(langs, pa.string()), pa.array(score),
                     pa.array(value, from_pandas=True), pa.array(bad)],
                    ["row", "lang_pred", "score", "cross_entropy", "rejected"])

    return packed.mapInArrow(run, f"row {row_type}, {RESULT}")


def predict(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, held_out, lang_pred, score,
    cross_entropy, rejected)``.  The model is learned from the labelled rows that
    are not held out; only the text is used to predict.  Null texts are ``und``;
    without any labelled row all are."""
    docs = docs.select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs, per_language))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score",
                      "cross_entropy", "rejected")


def keep_identified(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """The rows of ``docs`` that are not rejected; same columns."""
    model = train(docs.select("doc_id", "text", "lang"), per_language)
    return identify(docs, model).where(~F.col("rejected")).select("row.*")
