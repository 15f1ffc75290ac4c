import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import line_crf
from feedloom.llm.common import blocks

SF = "/root/testdata/sf0.01"


def block_of(*texts):
    return next(blocks(pa.array(texts), 1 << 30))


def test_lines_of_texts():
    b = block_of("", "a\nb", "\n", "x", "", "ü\n\nz\n")
    lines = line_crf.lines_of(b)
    got = [[b.data[s:e].tobytes().decode() for s, e in zip(lines.starts[i:j], lines.ends[i:j])]
           for i, j in zip(lines.first, lines.first[1:])]
    assert got == [[""], ["a", "b"], ["", ""], ["x"], [""], ["ü", "", "z", ""]]


def test_features_do_not_depend_on_other_texts():
    texts = ["One two two.\nTHREE!! four\n\n", "", "a | b | c", "é é é é", "x\nx\nx", "\n\n", "##a $$b"]
    together = block_of(*texts)
    lines = line_crf.lines_of(together)
    x = line_crf.features(together, lines)
    assert x.shape == (len(lines.starts), line_crf.WIDTH)
    for i, t in enumerate(texts):
        alone = block_of(t)
        own = line_crf.features(alone, line_crf.lines_of(alone))
        assert np.allclose(x[lines.first[i]:lines.first[i + 1]], own), t


def brute_chain(score, table):
    """Marginals by listing all labellings of one chain."""
    n = len(score)
    weights = {}
    for ys in itertools.product((0, 1), repeat=n):
        s = sum(score[i] * y for i, y in enumerate(ys)) + sum(table[a, b] for a, b in zip(ys, ys[1:]))
        weights[ys] = np.exp(s)
    z = sum(weights.values())
    good = [sum(w for ys, w in weights.items() if ys[i]) / z for i in range(n)]
    pairs = [[[sum(w for ys, w in weights.items() if (ys[i - 1], ys[i]) == (a, b)) / z for b in (0, 1)] for a in (0, 1)]
             for i in range(1, n)]
    return good, pairs, np.log(z)


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 8, 5)
        first = np.concatenate([[0], np.cumsum(sizes)])
        score, table = rng.normal(0, 2, first[-1]), rng.normal(0, 1, (2, 2))
        c = line_crf.chains(score, table, first)
        for d, (i, j) in enumerate(zip(first, first[1:])):
            good, pairs, log_z = brute_chain(score[i:j], table)
            assert np.allclose(c.good[i:j], good)
            assert np.allclose(c.pairs[i + 1:j], np.array(pairs).reshape(-1, 2, 2)) and not c.pairs[i].any()
            assert np.isclose(c.log_z[d] + c.shift[i:j].sum(), log_z)


def test_long_chain_stays_finite():
    score = np.tile([30.0, -30.0], 50000)
    c = line_crf.chains(score, np.array([[1.0, -1], [-1, 1]]), np.array([0, len(score)]))
    assert np.isfinite(c.good).all() and np.isfinite(c.log_z).all() and c.good[0] > 0.5 > c.good[1]


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    b = block_of("Good line.\nAnother good one.", "BAD!! BAD!!\nx | y", "single")
    lines = line_crf.lines_of(b)
    x, y = line_crf.features(b, lines), np.array([1, 0, 1])
    theta = rng.normal(0, 0.3, line_crf.N_PARAMETERS)
    _, g = line_crf.likelihood(theta, x, y, lines.first)
    for i in [*rng.integers(0, line_crf.WIDTH, 12), *range(line_crf.WIDTH, line_crf.N_PARAMETERS)]:
        e = np.zeros_like(theta)
        e[i] = 1e-5
        up, down = (line_crf.likelihood(theta + s * e, x, y, lines.first)[0] for s in (1, -1))
        assert np.isclose((up - down) / 2e-5, g[i], atol=1e-5)


def test_minimise_finds_the_minimum():
    a = np.diag([1.0, 10, 100])
    at = line_crf.minimise(lambda v: (0.5 * (v - 1) @ a @ (v - 1), a @ (v - 1)), np.zeros(3), 100)
    assert np.allclose(at, 1, atol=0.01)


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.exists(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy_and_only_the_text_counts(spark, tables):
    docs, labels = tables
    got = line_crf.predict(docs, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    test = [i for i in truth if rows[i].held_out]
    assert sum(rows[i].predicted == truth[i] for i in test) >= 0.95 * len(test)
    good, bad = ([rows[i].score for i in test if truth[i] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.97
    # held-out labels, and all else but the text, change nothing
    changed = labels.withColumn("quality", F.when(line_crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = line_crf.predict(docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit(0).alias("score")), changed)
    again = {r.doc_id: r.score for r in other.collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in rows.items())


def test_lines_of_a_mixed_text(spark, tables):
    model = line_crf.train(*tables)
    text = "\n".join(["The of and that in. Is to the anion, of thender."] * 1 + ["Ation of the and, to thener."] +
                     ["| a | b | c | d | e | f"] * 2 + ["BUY!! NOW!! NOW!! NOW!! NOW!!"] * 4)
    df = spark.createDataFrame([(1, text, 2), (2, None, 3)], "id int, text string, lines int")
    one, none = line_crf.label_lines(df, model).orderBy("row.id").collect()
    assert [x.line for x in one.lines] == text.split("\n") and one.row.lines == 2
    assert one.lines[0].good > one.lines[-1].good
    assert [x.line for x in none.lines] == [""]


def test_odd_input(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "text"), (3, "word " * 200000), (4, "\n" * 5000), (5, "  \t")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = line_crf.predict(docs, none).collect()
    assert len(got) == len(rows) and {(r.score, r.predicted) for r in got} == {(0.5, 0)}
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (5, 1), (5, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    got = line_crf.predict(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # null is empty
    assert line_crf.predict(docs.where("false"), labels).count() == 0
