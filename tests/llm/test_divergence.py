import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedloom.llm import divergence


def brute(rows, min_docs, top):
    """Rows of ``(lang, source, text)``; the contract in plain Python integers."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
            for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        every = {s: Counter() for s in {d[1] for d in own}}
        for _, s, ts in own:
            every[s].update(t for t in ts if df[t] >= min_docs)
        whole = sum(every.values(), Counter())

        def p(counts, t):
            return 1 + 1000000000 * (counts[t] + 2) // (sum(counts.values()) + 2 * len(kept))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s, counts in every.items():
            pairs = [(o, sum(f(p(counts, t), p(every[o], t)) for t in kept)) for o in every if o != s]
            terms = [(t, f(p(counts, t), p(whole, t))) for t in kept if counts[t] and p(counts, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, i + 1) for i, (x, v) in enumerate(found[:most])]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("block, tile", [(1 << 15, 16), (3, 2)])
def test_audit_equals_brute_force(spark, block, tile):
    rnd = random.Random(block)
    words = ["Ab", "aB", "é", "naïve", "x1y", "日本", "z", "tie", "eit", "q", "w", "ſ", "K"]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", "s10", None]),
             " ".join(rnd.choices(words, [9, 1, 3, 1, 2, 1, 5, 2, 2, 1, 1, 1, 1], k=rnd.randint(0, 12)))) for _ in range(150)]
    rows += [("en", "s1", None), ("en", "", ""), ("fr", "lone", "only word"), ("en", "other", "nothing123kept"),
             ("it", "a", "rare"), ("it", "b", "words"), ("it", "c", None), ("en", "long", "Ab é " * 20000)]
    rows += [("en", "s1", "tie eit tie eit")] * 30
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "lang string, source string, text string, value int, term string")
    got = rows_of(divergence.audit(df, min_docs=3, top=4, terms_per_block=block, groups_per_tile=tile))
    assert got == brute(rows, 3, 4)
    assert any(r[0] == "it" and r[4] == 0 for r in got)  # no kept term: all pairs are there


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(df).count() == 0


def test_gallop_finds_what_is_there():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        within = np.unique(rnd.integers(0, 3000, rnd.integers(0, 900)))
        keys = np.unique(rnd.integers(-5, 3100, rnd.integers(0, 300)))
        at = divergence.gallop(keys, within)
        assert [within[a] if a >= 0 else None for a in at] == [k if k in set(within) else None for k in keys.tolist()]


def test_shares_are_exact_for_large_counts():
    for total in (7, 10**9 + 7, 2**53 - 1):
        counts = np.array(sorted({0, 1, total // 3, total - 2}))
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]


def test_terms_of_a_block_are_counted_by_group(spark):
    rows = [("en", "a", "One one two"), ("en", "a", "one"), ("en", "b", "two")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = {(r["source"], r["term"]): (r["n_docs"], r["n"]) for r in divergence.term_counts(df).collect()}
    want = defaultdict(tuple, {("a", "one"): (2, 3), ("a", "two"): (1, 1), ("b", "two"): (1, 1)})
    assert got == want
