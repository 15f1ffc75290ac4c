"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: all pre-tokens of a
block of documents are hashed and resolved at once.  A pre-token that is no
vocabulary entry goes to tier two: its bytes form a linked list, and a heap of
the neighbouring pairs yields the merge of lowest rank (leftmost first) until no
pair is in the vocabulary.  The results of tier two are kept in a bounded memo
per worker.

The vocabulary is a rank file (``base64 rank`` lines).  Its tables are broadcast;
``MAX_VOCABULARY_BYTES`` bounds the file."""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import blocks, mix, on_workers, range_hashes

MAX_VOCABULARY_BYTES = 64 << 20
MEMO_ENTRIES = 1_000_000  # of tier two, in each worker
KEYS_PER_BUCKET = 2
_STEP = np.uint64(0xA24BAED4963EE407)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line.strip())}


class PerfectHash:
    """Minimal perfect hash (hash and displace) from vocabulary entries to ids.

    A key's bucket has a displacement; a displaced hash gives the key's slot,
    and there are as many slots as keys.  Buckets are placed largest first;
    single keys take the remaining slots directly (stored as ``-slot - 1``).
    A slot keeps both hashes of its key, so that other strings are told apart."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        ends = np.cumsum([len(k) for k in keys], dtype=np.int64) if keys else np.empty(0, np.int64)
        data = np.frombuffer(b"".join(keys), np.uint8)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if keys else ends
        h1, h2 = (range_hashes(data, starts, ends, seed) for seed in (0, 1))
        n = max(1, len(keys))
        self.n, self.shift = n, np.zeros(max(1, n // KEYS_PER_BUCKET), np.int64)
        bucket = (h1 % np.uint64(len(self.shift))).astype(np.int64)
        members: dict[int, list[int]] = {}
        for i, b in enumerate(bucket.tolist()):
            members.setdefault(b, []).append(i)
        taken, slot = np.zeros(n, bool), np.zeros(len(keys), np.int64)
        singles = []
        for b, own in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                singles.append((b, own[0]))
                continue
            d, fits = 0, np.empty(0, int)
            while not len(fits):  # a run of displacements at a time
                at = np.sort(self._displaced(h1[own], np.arange(d, d + 32)[:, None]), axis=1)
                fits = np.flatnonzero(~taken[at].any(1) & (at[:, 1:] != at[:, :-1]).all(1))
                d += 32
            d += int(fits[0]) - 32
            at = self._displaced(h1[own], np.int64(d))
            self.shift[b], slot[own], taken[at] = d, at, True
        for (b, i), free in zip(singles, np.flatnonzero(~taken).tolist()):
            self.shift[b], slot[i] = -free - 1, free
        self.h1, self.h2, self.ids = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, -1, np.int64)
        self.h1[slot], self.h2[slot], self.ids[slot] = h1, h2, list(ranks.values())

    def _displaced(self, h: np.ndarray, d: np.ndarray | np.int64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(h + np.asarray(d).astype(np.uint64) * _STEP) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Ids of strings by their two hashes; -1 for others."""
        d = self.shift[(h1 % np.uint64(len(self.shift))).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._displaced(h1, d))
        return np.where((self.h1[slot] == h1) & (self.h2[slot] == h2), self.ids[slot], -1)


ID_BITS = 24


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """The id that two neighbouring ids merge into, for all pairs that do."""
    out = {}
    for token, merged in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left << ID_BITS | right] = merged
    return out


def merge_bytes(piece: bytes, byte_ids: list[int], first: list[int | None], merges: dict[int, int]) -> tuple[int, ...]:
    """Ids of a pre-token by merging its bytes.  A merged id is its rank;
    ``first`` has the merged ids of all pairs of bytes."""
    n, merged, push, pop = len(piece), merges.get, heapq.heappush, heapq.heappop
    ids = [byte_ids[b] for b in piece]  # -1 where merged into the part before
    ranks = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]  # of each part with the next; stale heap entries differ
    ranks.append(None)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << 32 | i for i, r in enumerate(ranks) if r is not None]
    heapq.heapify(heap)
    while heap:
        entry = pop(heap)
        i = entry & 0xFFFFFFFF
        rank = ranks[i]
        if rank is None or entry >> 32 != rank:
            continue
        j = after[i]
        ids[i], ids[j], ranks[j] = rank, -1, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            ranks[i] = r = merged(rank << ID_BITS | ids[k])
            if r is not None:
                push(heap, r << 32 | i)
        else:
            ranks[i] = None
        h = before[i]
        if h >= 0:
            ranks[h] = r = merged(ids[h] << ID_BITS | rank)
            if r is not None:
                push(heap, r << 32 | h)
    return tuple([i for i in ids if i >= 0])


class Codec:
    """A vocabulary's tables in a worker, and the memo of tier two: both hashes
    of a pre-token, sorted by the first, and where its ids lie in ``flat``."""

    def __init__(self, ranks: dict[bytes, int], perfect: PerfectHash, pattern: str):
        self.perfect, self.merges = perfect, merge_table(ranks)
        self.byte_ids = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.first = [ranks.get(bytes([a, b])) for a in range(256) for b in range(256)]
        self.split = regex.compile(pattern).findall
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.h1, self.h2 = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def merged(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray,
               ) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``flat`` and number of the ids of each missed pre-token."""
        if len(self.h1) > MEMO_ENTRIES:
            self._forget()
        keys, first, back = np.unique(h1, return_index=True, return_inverse=True)
        at = np.searchsorted(self.h1, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.h1)
        known[inside] = self.h1[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        ids = [merge_bytes(raw[s:e], self.byte_ids, self.first, self.merges)
               for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        begins = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))])
        self.h1, self.h2 = np.insert(self.h1, at[new], keys[new]), np.insert(self.h2, at[new], h2[first[new]])
        self.start, self.count = np.insert(self.start, at[new], begins), np.insert(self.count, at[new], counts)
        row = np.searchsorted(self.h1, keys)[back]
        start, count = self.start[row], self.count[row]
        for i in np.flatnonzero(self.h2[row] != h2):  # other strings with the same first hash
            own = np.array(merge_bytes(raw[starts[i]:ends[i]], self.byte_ids, self.first, self.merges), np.int32)
            start[i], count[i] = len(self.flat), len(own)
            self.flat = np.concatenate([self.flat, own])
        return start, count

    def encode_block(self, block, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's documents in one array, and its offsets."""
        pieces = [self.split(t) for t in texts]
        lengths = np.fromiter(map(len, chain.from_iterable(pieces)), np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        byte_at = np.append(np.flatnonzero((block.data & 0xC0) != 0x80), len(block.data))[at]
        starts, ends = byte_at[:-1], byte_at[1:]
        h1, h2 = (range_hashes(block.data, starts, ends, seed) for seed in (0, 1))
        ids = self.perfect.lookup(h1, h2)
        miss = np.flatnonzero(ids < 0)
        count = np.ones(len(ids), np.int64)
        if len(miss):
            place, count[miss] = self.merged(block.data.tobytes(), starts[miss], ends[miss], h1[miss], h2[miss])
        stops = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(int(stops[-1]), np.int32)
        out[stops[:-1][ids >= 0]] = ids[ids >= 0]
        if len(miss):
            n = count[miss]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(stops[miss], n) + step] = self.flat[np.repeat(place, n) + step]
        return out, stops[np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)]


    def decode(self, flat: np.ndarray, stops: np.ndarray) -> pa.Array:
        """The bytes of each document's ids; ``stops`` are offsets into them."""
        n = self.sizes[flat]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(int(ends[-1])) + np.repeat(self.begins[flat] - ends[:-1], n)
        return pa.Array.from_buffers(pa.large_binary(), len(stops) - 1, [
            None, pa.py_buffer(ends[stops].astype(np.int64)), pa.py_buffer(self.bytes[at])]).cast(pa.binary())


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else shared._path
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*shared.value)
    return _codecs[key]


class Tokenizer:
    """``encode`` and ``decode`` for one rank file and split pattern.

    The pattern must match every character of a text, as the public patterns
    do; what it leaves out would be lost."""

    def __init__(self, spark, path: str, pattern: str):
        on_workers(spark)
        ranks = read_ranks(path)
        self._shared = spark.sparkContext.broadcast((ranks, PerfectHash(ranks), pattern))

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
        """``(id_col, ids array<int>)``, one row per row: every match of the
        pattern encoded separately, no special tokens.  Null and empty texts
        have no ids.  ``decoded`` adds the bytes that the ids decode to, as
        ``decode`` would, in the same pass.  Other columns are ignored."""
        shared = self._shared

        def run(batches):
            codec = _codec(shared)
            for batch in batches:
                texts = pc.fill_null(batch.column(1), "")
                for b in blocks(texts, 1 << 20):
                    flat, stops = codec.encode_block(b, texts.slice(b.lo, len(b)).to_pylist())
                    ids = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(flat))
                    columns = {"id": batch.column(0).slice(b.lo, len(b)), "ids": ids}
                    if decoded:
                        columns["decoded"] = codec.decode(flat, stops)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        id_type = docs.select(id_col).schema[0].dataType.simpleString()
        result = f"id {id_type}, ids array<int>" + ", decoded binary" * decoded
        return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, result).withColumnRenamed("id", id_col)

    def decode(self, encoded: DataFrame, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
        """Adds the bytes of the ids as a binary column; null ids give null."""
        shared = self._shared

        @F.pandas_udf("binary")
        def to_bytes(column: pd.Series) -> pd.Series:
            filled = [np.empty(0, np.int32) if ids is None else ids for ids in column]
            stops = np.concatenate([[0], np.cumsum([len(x) for x in filled])]).astype(np.int64)
            flat = np.concatenate(filled) if len(filled) else np.empty(0, np.int32)
            out = pd.Series(_codec(shared).decode(flat, stops).to_pylist(), dtype=object)
            return out.where(column.notna().to_numpy(), None)

        return encoded.withColumn(to, to_bytes(ids_col))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the encoded and
    again decoded texts."""
    tokenizer = Tokenizer(docs.sparkSession, path, pattern)
    return tokenizer.encode(docs, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
