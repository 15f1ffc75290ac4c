import hashlib
import random
import re

import pytest

from feedloom.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, ws in words:
        for i in range(len(ws) - k + 1):
            if d is not None:
                key = tuple(ws[i:i + k])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, ws in words:
        gone = set()
        for i in range(len(ws) - k + 1):
            if d is not None and first[tuple(ws[i:i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((-1 if d is None else d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, k, anchor, cols="doc_id long, text string, start string, n long"):
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], cols)
    out = substring_dedup.dedup(df, k, anchor).collect()
    texts = {r.doc_id: WORD.findall(t or "") for r in out for d, t in rows if d == r.doc_id}
    for r in out:
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        for f in r.factors:  # a factor is a real piece of an earlier row, long enough
            assert f.ref_doc < r.doc_id and f.n >= k
            assert texts[r.doc_id][f.start:f.start + f.n] == texts[f.ref_doc][f.ref_start:f.ref_start + f.n]
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "ça", "word x", "日本", "z."]
    bank = [[rnd.choice(vocab) for _ in range(rnd.randint(5, 40))] for _ in range(12)]
    rows = []
    for d in rnd.sample(range(1000), 60):
        ws = []
        for _ in range(rnd.randint(0, 6)):
            piece = rnd.choice(bank)
            a = rnd.randint(0, len(piece) - 1)
            ws += piece[a:rnd.randint(a, len(piece))] + [rnd.choice(vocab) for _ in range(rnd.randint(0, 3))]
        rows.append((d, rnd.choice(["", "\n "]) + rnd.choice([" ", "\n", "\t \x0b"]).join(ws)))
    assert run(spark, rows, 10, 4) == brute(rows, 10)


def test_edges(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(5, None), (6, ""), (7, " \n\t"), (1, p), (2, p), (2, p), (3, p + " tail"), (4, "head " + p[3:]),
            (8, "x " * 300), (9, "x " * 120), (None, p), (10, " ".join(p.split()[:49])),
            (11, " ".join(p.split()[5:30] + p.split()[5:45] + p.split()[20:60]))]
    assert run(spark, rows, 50, 16) == brute(rows, 50)


def test_empty_table(spark):
    assert run(spark, [], 50, 16) == []


def test_a_passage_in_a_third_of_the_rows(spark):
    rnd = random.Random(1)
    shared = " ".join(f"s{i}" for i in range(80))
    rows = [(d, " ".join(f"u{rnd.random()}" for _ in range(30)) + (" " + shared + " " if d % 3 == 0 else " ")
             + " ".join(f"v{rnd.random()}" for _ in range(30))) for d in range(150)]
    assert run(spark, rows, 50, 16) == brute(rows, 50)
