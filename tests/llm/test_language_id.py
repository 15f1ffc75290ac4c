import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import language_id as L
from feedloom.llm import queries
from feedloom.llm.common import blocks


def brute_model(texts, symbols):
    """Interpolated Kneser-Ney by dictionaries: tuple of symbols -> probability."""
    counts = [Counter() for _ in range(L.ORDER)]
    for t in texts:
        s = [0] * (L.ORDER - 1) + [int(symbols[ord(c)]) for c in t]
        counts[-1].update(tuple(s[i - L.ORDER + 1:i + 1]) for i in range(L.ORDER - 1, len(s)))
    for k in range(L.ORDER - 1, 0, -1):
        counts[k - 1].update(g[1:] for g in counts[k])
    stats = []
    for c in counts:
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        total, kinds = defaultdict(int), defaultdict(int)
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        stats.append((ones / (ones + 2 * twos) if ones and twos else 0.75, total, kinds))
    vocabulary = len(np.unique(symbols))

    def p(g):
        if not g:
            return 1 / vocabulary
        d, total, kinds = stats[len(g) - 1]
        ctx = g[:-1]
        if not total.get(ctx):
            return p(g[1:])
        return (max(counts[len(g) - 1][g] - d, 0) + d * kinds[ctx] * p(g[1:])) / total[ctx]

    return p


def test_model_equals_brute_force():
    rnd = random.Random(2)
    texts = {lang: ["".join(rnd.choice(abc) for _ in range(rnd.randint(1, 60))) for _ in range(12)]
             for lang, abc in (("aa", "ab é1."), ("bb", "bcd ü"))}
    symbols = L.symbol_table(sorted("abcdéü"))
    counts = {}
    for lang, ts in texts.items():
        for b in blocks(pa.array(ts)):
            cps, first = L._code_points(b)
            counts[lang] = np.unique(L._grams(symbols[cps], first), return_counts=True)
    model = L.kneser_ney(counts, symbols)
    tests = ["abc édü1", "zz Ωb", "ÉÜ", "a", "ddddddddd"]
    for b in blocks(pa.array(tests)):
        n, letters, entropy, lp = model.entropies(b)
        assert n.tolist() == [len(t) for t in tests]
        for i, lang in enumerate(model.languages):
            p, at = brute_model(texts[lang], symbols), 0
            for d, t in enumerate(tests):
                s = [0] * (L.ORDER - 1) + [int(symbols[ord(c)]) for c in t]
                want = [math.log(p(tuple(s[j - L.ORDER + 1:j + 1]))) for j in range(L.ORDER - 1, len(s))]
                assert np.allclose(lp[at:at + len(t), i], want, atol=1e-4)
                assert entropy[d, i] == pytest.approx(-sum(want) / len(t), abs=1e-4)
                at += len(t)


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in test) >= 0.98 * len(test)
    assert sum(r.rejected for r in got) < 0.01 * len(got)


def test_edges_and_rejection(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(ws) for _ in range(60)), lang, "s")
            for lang, ws in (("x", ["alpha", "beta", "gamma"]), ("y", ["uno", "dos", "tres"]))
            for i in range(0 if lang == "x" else 100, 40 if lang == "x" else 140)]
    odd = [(500, None, "x", "s"), (501, "", "y", "s"), (502, "123 !? \n", None, "s"), (503, "uno dos tres uno", None, "s"),
           (503, "uno dos tres uno", None, "s"), (None, "alpha beta", "x", "s"), (504, "alpha gamma " * 20000, None, "s"),
           (505, "qzqzqzqxvkkj wwq " * 40, None, "s")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, rejected string")
    got = {}
    for r in L.predict(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    assert all(got[i][0].score == 0 and got[i][0].rejected for i in (500, 501, 502))
    assert [r.lang_pred for r in got[503]] == ["y", "y"] and got[504][0].lang_pred == "x"
    assert got[None][0].lang_pred == "x" and got[None][0].held_out is False
    assert got[505][0].rejected and not got[504][0].rejected
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) + len(odd) - 4
    empty = spark.createDataFrame([], df.schema)
    assert L.predict(empty).count() == 0
    unlabelled = df.withColumn("lang", L.F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.predict(unlabelled).collect()} == {"und"}


def test_many_letters_are_told_apart():
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    symbols = L.symbol_table(letters)
    assert len({int(symbols[ord(c)]) for c in letters}) == 3000
    packed = L._grams(symbols[np.array([ord(c) for c in letters[-5:]])], np.array([0, 5]))
    last = int(packed[-1])
    assert [last >> (L.SYMBOL_BITS * k) & ((1 << L.SYMBOL_BITS) - 1) for k in range(4, -1, -1)] \
        == [int(symbols[ord(c)]) for c in letters[-5:]]
