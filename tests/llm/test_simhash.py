import re

import pytest
import xxhash
from pyspark.sql import functions as F

from feedloom.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=4):
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                up[find(a)] = find(b)
    least = {}
    for d, f in rows:
        r = find(f)
        least[r] = min(d, least.get(r, d))
    return sorted((d, f"{f:016x}", least[find(f)]) for d, f in rows)


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op9_simhash_near_dedup(spark, sf).collect()))
    assert got == brute_components([(r.doc_id, brute_fp(r.text)) for r in rows])


def test_nulls_ties_and_short_texts(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", " \t\n", "one", "One", "a b c", base, base, base.replace("w7 ", "x7 "), "Ärger ÄRGER x y z",
             "word " * 5000, "\x0bA\x0cB\rC D  E"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "one", "y")],
                               "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == brute_components([(i, brute_fp(t)) for i, t in enumerate(texts)] + [(3, brute_fp("one"))])


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, "q")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}


@pytest.mark.parametrize("radius,prefix_bits", [(0, 6), (2, 6), (4, 6), (4, 14), (6, 8)])
def test_links_on_planted_fingerprints(spark, radius, prefix_bits):
    import random
    rnd = random.Random(radius * 100 + prefix_bits)
    centers = [rnd.getrandbits(64) for _ in range(25)]
    fps = set(centers)
    for c in centers:
        for _ in range(6):
            f = c
            for b in rnd.sample(range(64), rnd.randint(0, 8)):
                f ^= 1 << b
            fps.add(f)
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(sign(f),) for f in sorted(fps)], "fp long")
    got = {}

    def find(x):
        while got.get(x, x) != x:
            x = got[x]
        return x

    for r in simhash.links(df, radius, prefix_bits).collect():
        got[find(r.a)] = find(r.b)
    up = {}

    def find2(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    fl = sorted(fps)
    for i, a in enumerate(fl):
        for b in fl[:i]:
            if (a ^ b).bit_count() <= radius:
                up[find2(a)] = find2(b)
    pairs = lambda f, g: {(i, j) for i in range(len(fl)) for j in range(i) if f(g(fl[i])) == f(g(fl[j]))}
    assert pairs(find, sign) == pairs(find2, lambda x: x)


def test_sliced_buckets_equal_whole_ones(monkeypatch):
    import numpy as np
    rnd = np.random.default_rng(3)
    fps = np.unique(rnd.integers(0, 1 << 20, 300, dtype=np.uint64))
    whole = simhash._bucket_links(fps, 0, 6, 4)
    monkeypatch.setattr(simhash, "VARIANTS_PER_TASK", 1 << 12)
    cut = simhash._bucket_links(fps, 0, 6, 4)

    def groups(a, b):
        label = simhash._forest(len(fps), np.searchsorted(fps, a), np.searchsorted(fps, b))
        return label.tolist()

    assert groups(*whole) == groups(*cut)


def test_keep_one_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a b c d", "en"), (1, "a b c d", "fr"), (None, "a b c d", "de"), (4, "zz", None)],
                               "doc_id long, text string, lang string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.select(F.col("doc_id")).collect()) == [0, 1, 4]
