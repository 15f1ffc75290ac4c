"""Rows that share an id, ids far apart and columns named like the operators' own."""

import random

from feedloom.llm import line_dedup, sharding, simhash, substring_dedup
from test_sharding import jump
from test_substring_dedup import brute


def test_rows_of_one_id_with_different_texts(spark):
    rnd = random.Random(2)
    passages = [[f"p{i}w{j}" for j in range(30)] for i in range(4)]
    rows = [(5, " ".join(passages[0] + passages[1])), (5, "short"), (5, " ".join(passages[2])), (5, "short"),
            (9, " ".join(passages[1] + passages[0])), (9, " ".join(["x"] + passages[2] + passages[1]))]
    rows += [(rnd.randint(0, 12), " ".join(rnd.choice(passages)[rnd.randint(0, 15):] + rnd.choice(passages))) for _ in range(40)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, text_id int")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, 10, 4).collect())
    assert got == brute(rows, 10)


def test_shards_of_ids_far_apart(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_IDS", 16)
    ids = [-5 * 10**18, 5 * 10**18, -2**63, 2**63 - 1, *range(100)]
    rows = [(i, "x") for i in ids] + [(None, f"no id {i}") for i in range(60)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(ids) and len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.shard == jump(r.doc_id or 0, 4)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_columns_named_like_the_operators_own(spark):
    form = "the {} house of this very long street is green"
    rows = [(i, form.format("red") + f"\nown {i}", 1, 2, ["x"], {"a": i}) for i in (1, 2)] + [(3, "a b c d", 3, 4, None, None), (4, "a b c d", 3, 4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_drop` int, of int, gone array<string>, row map<string, int>")
    one = simhash.keep_one(df)
    assert one.columns == df.columns and sorted(r.doc_id for r in one.collect()) == [1, 2, 3]
    ids = simhash.repeated_ids(df)
    out = line_dedup.without_repeated_passages(df, without=ids)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, rows[0][1]), (2, "own 2"), (3, "a b c d")]


def test_documents_that_go_do_not_count_for_passages(spark):
    passage = "a line of eight words or of more words"
    rows = [(1, passage + "\nfirst"), (2, passage + "\nsecond"), (3, passage + "\nthird"), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1,)], "doc_id long")
    out = line_dedup.without_repeated_passages(df, without=ids).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, passage), (2, rows[1][1]), (3, "third")]
