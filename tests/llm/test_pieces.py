"""Fingerprints of texts without a line feed."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from feedloom.llm import fingerprints as P


def text(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéß漢") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_pieces_cover_the_text_and_stay_in_their_paragraph():
    texts = ["\n".join(text(i * 7 + j, n) for j, n in enumerate((0, 3, 400, 40))) for i in range(30)] + ["", "a" * 5000, "long " * 3000]
    for t in texts:
        raw = t.encode()
        b = next(P.blocks(pa.array([t])))
        start, stop, at = [], [], 0
        for line in raw.split(b"\n"):
            start.append(at)
            stop.append(at + len(line))
            at += len(line) + 1
        s, e, of = P._cut(b.data, P.np.array(start), P.np.array(stop))
        joined = [b""] * len(start)
        for lo, hi, p in zip(s, e, of):
            joined[p] += raw[lo:hi]
            assert hi - lo <= P.LONGEST
        assert joined == raw.split(b"\n")


def test_digests_do_not_depend_on_the_neighbours():
    texts = [text(i, 100) for i in range(400)] + ["a" * 400, "x" + "a" * 400]
    key, owner = P.digests(pa.array(texts), True)
    for i in range(len(texts)):
        assert Counter(key[owner == i].tolist()) == Counter(P.digests(pa.array([texts[i]]), True)[0].tolist())


def test_half_the_same_is_neither_unlike_nor_alike(spark):
    rows = [(i, text(i, 400)) for i in range(20)]
    for r in P.versions(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 0.1 < r.near_edited < 0.6 and r.near_next < 0.05
    same = text(99, 300)
    pairs = spark.createDataFrame([(same, same + " end"), (same, "new " + same), (same, same)], "first string, second string")
    first, second, third = [r.likeness for r in P.compare(pairs).collect()]
    assert 0.8 < first < 1 and 0.8 < second < 1 and third == pytest.approx(1)
