import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import fingerprints as P
from feedloom.llm import queries


def pieces(t):
    return Counter(P.digests(pa.array([t]), True)[0].tolist())


def lines(t):
    return Counter(t.split("\n")) if t else Counter()


def near(a, b, parts=pieces):
    a, b = parts(a), parts(b)
    either = (a | b).total()
    return (a & b).total() / either if either else 1.0


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        out.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), near(t, edited), near(t, after)))
    return sorted(out)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op2_fingerprints(spark, sf).collect()
    want = brute(rows)
    have = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got)
    assert [x[:3] for x in have] == [x[:3] for x in want]
    assert np.allclose([x[3:] for x in have], [x[3:] for x in want])
    texts, prints = dict(rows), {}
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


@pytest.mark.parametrize("n", [0, 1, 2, 300, 1500])
def test_order_nulls_ties_and_long_texts(spark, n):
    rnd = random.Random(n)
    lines = ["a", "b", "", "é🙂 line", "long " * 50, "c"]
    rows = [(i * 7 - 50, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 6)))) for i in rnd.sample(range(5000), n)]
    if n > 100:
        rows += [(None, "null id"), (rows[0][0], "same id"), (-900, None), (99999, "\n".join(f"p{i % 700}" for i in range(3000))),
                 (99998, "\n".join(f"p{i}" for i in range(2500)))]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, range int, after string")
    got = P.versions(df).collect()
    have = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got)
    want = brute(rows)
    assert [x[:3] for x in have] == [x[:3] for x in want]
    assert np.allclose([x[3:] for x in have] or [[]], [x[3:] for x in want] or [[]])


def test_peeling_recovers_the_differing_digests(spark):
    rnd = random.Random(6)
    texts = [("\n".join(f"p{rnd.randint(0, 400)}" for _ in range(rnd.choice([0, 1, 5, 60, 400])))) for _ in range(80)]
    pairs = list(zip(texts, texts[1:] + texts[:1])) + [("", ""), ("x\nx\nx", "x"), (texts[0], texts[0])]
    a, b = P.digests(pa.array([x for x, _ in pairs])), P.digests(pa.array([y for _, y in pairs]))
    key, pair, sign = P.differences(a, b, len(pairs))
    for i in range(len(pairs)):
        ka, kb = set(a[0][a[1] == i].tolist()), set(b[0][b[1] == i].tolist())
        assert set(key[(pair == i) & (sign == 1)].tolist()) == ka - kb
        assert set(key[(pair == i) & (sign == -1)].tolist()) == kb - ka
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)] + [(-1, None, "q")], "i int, first string, second string")
    for r in P.compare(df).collect():
        assert r.likeness == pytest.approx(near(r.row.first or "", r.row.second or "", lines))
        assert len(r.only_a) == (Counter((r.row.first or "").split("\n") if r.row.first else []) - Counter(
            (r.row.second or "").split("\n") if r.row.second else [])).total()
