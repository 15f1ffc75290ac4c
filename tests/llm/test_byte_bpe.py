import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import byte_bpe, queries
from feedloom.llm.common import blocks, range_hashes

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = byte_bpe.Codec(RANKS, byte_bpe.PerfectHash({b"a": 0}), P.PATTERN)


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = ENC.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.op10_byte_bpe(spark, sf).collect())) == sorted(want)


def test_edges_round_trip(spark):
    texts = [None, "", " ", "  \n\n x", "don't 'S 's I'll  we've\t'd", "日本語 ½ Ⅷ ☃️ 🙂🙂", "a" * 3000, "é" * 2000,
             "\x00\x01", "<|endoftext|>", " naïve  café ", "x　y z"]
    df = spark.createDataFrame([(i, t, [9], "z") for i, t in enumerate(texts)] + [(1, "", [1], "q")],
                               "doc_id long, text string, ids array<int>, id string")
    tok = byte_bpe.Tokenizer(spark, PATH, P.PATTERN)
    rows = tok.decode(tok.encode(df)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r.doc_id] or ""
        assert list(r.ids) == ENC.encode_ordinary(t) and bytes(r.decoded).decode() == t
    assert sorted(map(str, rows)) == sorted(map(str, tok.encode(df, decoded=True).collect()))
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "doc_id long, ids array<int>")
    assert [r.decoded for r in tok.decode(odd).orderBy("doc_id").collect()] == [None, b"", b"ab"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digests(empty, PATH, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=40))
def test_merges_equal_the_library(text):
    for piece in byte_bpe.regex.findall(P.PATTERN, text):
        if piece.encode() not in RANKS:
            assert list(byte_bpe.merge_bytes(piece.encode(), CODEC.byte_ids, CODEC.first, CODEC.merges)) == ENC.encode_ordinary(piece)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_perfect_hash_is_minimal_and_exact(n):
    some = {t: i for i, t in enumerate(list(RANKS)[300:300 + n])}
    ph = byte_bpe.PerfectHash(some)
    keys = list(some) + [b"", b"no such", b"zzzzqq"]
    data = np.frombuffer(b"".join(keys), np.uint8)
    ends = np.cumsum([len(k) for k in keys])
    starts = np.concatenate([[0], ends[:-1]])
    got = ph.lookup(*(range_hashes(data, starts, ends, seed) for seed in (0, 1)))
    assert got.tolist() == [some.get(k, -1) for k in keys]
    assert len(ph.ids) == max(1, n)


def test_the_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_ENTRIES", 3)
    codec = byte_bpe.Codec(RANKS, byte_bpe.PerfectHash({b"a": 0}), P.PATTERN)
    for words in [["thonnd", "erthat a", "", "ndonre thonnd"], ["qqqwx erthat"], ["thonnd a a"] * 3, ["x"]] * 3:
        for b in blocks(pa.array(words)):
            flat, stops = codec.encode_block(b, words)
            assert [flat[s:e].tolist() for s, e in zip(stops, stops[1:])] == [ENC.encode_ordinary(w) for w in words]


def test_equal_first_hashes_are_told_apart():
    codec = byte_bpe.Codec(RANKS, byte_bpe.PerfectHash({b"a": 0}), P.PATTERN)
    one = np.array([5, 5, 5], np.uint64)
    start, count = codec.merged(b"thonndqqqwx", np.array([0, 6, 0]), np.array([6, 11, 6]), one, np.array([1, 2, 1], np.uint64))
    got = [codec.flat[s:s + n].tolist() for s, n in zip(start, count)]
    assert got == [ENC.encode_ordinary(w) for w in ("thonnd", "qqqwx", "thonnd")]
