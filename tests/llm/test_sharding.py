import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from feedloom.llm import sharding


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


KEYS = [0, 1, -1, 7, 2**63 - 1, -2**63, 10**15] + [random.Random(9).getrandbits(63) for _ in range(300)]


@pytest.mark.parametrize("n", [1, 2, 40, 41, 64, 65, 1000])
def test_jump_hash_equals_the_published_loop(spark, n):
    df = spark.createDataFrame([(k,) for k in KEYS], "k long").select("k", sharding.jump_hash("k", n).alias("s"))
    assert {r.k: r.s for r in df.collect()} == {k: jump(k, n) for k in KEYS}


def test_rows_slots_and_growth(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_IDS", 16)
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["é", "", "abc" * 50, None]), 5) for i in rnd.sample(range(-500, 10**6), 300)]
    rows += [rows[0]] * 40 + [(None, "x", 5), (None, None, 6), (rows[1][0], "other", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sharding.shard(df, 7).collect()
    want = sorted(((d or 0) if d is None else d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        key = r.doc_id or 0
        assert r.law == "key" and r.shard == jump(key, 7) and r.grown_shard == jump(key, 8)
        assert r.grown_shard in (r.shard, 7)
        slots[r.shard].append((r.slot, (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)))
    for own in slots.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own)))
        assert [x for _, x in own] == sorted(x for _, x in own)


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(df, 40).count() == 0
    plan = sharding.shard(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 40) \
        ._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
