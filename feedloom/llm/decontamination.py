"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document if at least ``threshold`` of the item's
distinct word shingles occur in it.  Items are partitioned by the number of
their shingles; all items of a partition get a bottom-k MinHash sketch (their k
smallest shingle hashes) of one length.  The length follows from the partition's
largest size u: an item that misses at most ``u - ceil(threshold * u)`` shingles
has at least one of the ``k = u - ceil(threshold * u) + 1`` sketch values among
the document's shingles, however long the document is.  So no contained item is
missed, and most documents meet no sketch value at all.  Documents that do are
verified by exact shingle containment, on the words themselves.

The items are the stated query set: they are broadcast in blocks of at most
about ``BLOCK_BYTES`` of text, and every block is held against all documents."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import blocks, on_workers, range_hashes, run_hashes, words_of

BLOCK_BYTES = 8 << 20
FILTER_BITS = 20
HITS = "array<struct<item_id:bigint,shared:bigint,item_shingles:bigint>>"

# Word characters are ASCII letters and digits and all other than ASCII ones.
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def _word_bytes(block, words, d: int) -> list[bytes]:
    raw = block.data.tobytes()
    a, b = words.first[d], words.first[d + 1]
    return [raw[s:e] for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())]


def _shingles(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)}


@dataclass
class Partition:
    """Items of nearly one size: their sketch values, sorted, and whose they are."""

    size_to: int
    sketch: int
    values: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    owners: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


class Index:
    """The sketches of a block of items, by shingle length and size partition."""

    def __init__(self, items: list[tuple[int, str]], k: int, threshold: float):
        self.threshold = threshold
        self.items: list[tuple[int, int, np.ndarray, set[bytes]]] = []  # id, shingle length, hashes, shingles
        texts = pc.utf8_lower(pa.array([t for _, t in items], pa.string()))
        for b in blocks(texts):
            w = words_of(b, _SEPARATORS)
            wh = range_hashes(b.data, w.starts, w.ends)
            for d in range(len(b)):
                n = int(w.first[d + 1] - w.first[d])
                if n:
                    length = min(k, n)
                    at = np.arange(w.first[d], w.first[d + 1] - length + 1)
                    self.items.append((items[b.lo + d][0], length, np.unique(range_hashes(wh, at, at + length)),
                                       _shingles(_word_bytes(b, w, d), length)))
        self.partitions: dict[int, list[Partition]] = {}
        self.filters: dict[int, np.ndarray] = {}
        for length in {i[1] for i in self.items}:
            sized: dict[int, list[int]] = {}
            for i, (_, own, hashes, _) in enumerate(self.items):
                if own == length:
                    sized.setdefault(len(hashes).bit_length(), []).append(i)
            self.filters[length] = np.zeros(1 << FILTER_BITS, bool)
            for bits, members in sorted(sized.items()):
                top = (1 << bits) - 1
                part = Partition(top, top - math.ceil(threshold * top - 1e-9) + 1)
                sketches = [self.items[i][2][:part.sketch] for i in members]
                values, owners = np.concatenate(sketches), np.repeat(members, [len(s) for s in sketches])
                by = np.argsort(values)
                part.values, part.owners = values[by], owners[by]
                self.partitions.setdefault(length, []).append(part)
                self.filters[length][(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, block) -> list[list[dict]]:
        """Contained items per document of a block."""
        w = words_of(block, _SEPARATORS)
        wh = range_hashes(block.data, w.starts, w.ends)
        out: list[list[dict]] = [[] for _ in range(len(block))]
        for length, parts in self.partitions.items():
            hashes, whole = run_hashes(wh, w.first, length)
            probe = np.flatnonzero(whole & self.filters[length][(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            pairs: set[tuple[int, int]] = set()
            for part in parts:
                a = np.searchsorted(part.values, hashes[probe], "left")
                b = np.searchsorted(part.values, hashes[probe], "right")
                met = np.flatnonzero(b > a)
                docs = np.searchsorted(w.first, probe[met], "right") - 1
                for d, x, y in zip(docs.tolist(), a[met].tolist(), b[met].tolist()):
                    pairs.update((d, i) for i in part.owners[x:y].tolist())
            sets: dict[int, tuple[np.ndarray, set[bytes]]] = {}
            for d, i in sorted(pairs):
                item_id, _, item_hashes, item_shingles = self.items[i]
                if d not in sets:
                    sets[d] = (hashes[w.first[d]:w.first[d + 1] - length + 1], set())
                if np.isin(item_hashes, sets[d][0]).sum() < self.threshold * len(item_shingles) - 1e-9:
                    continue
                if not sets[d][1]:
                    sets[d] = (sets[d][0], _shingles(_word_bytes(block, w, d), length))
                shared = len(item_shingles & sets[d][1])
                if shared >= self.threshold * len(item_shingles) - 1e-9:
                    out[d].append({"item_id": item_id, "shared": shared, "item_shingles": len(item_shingles)})
        return [sorted(h, key=lambda x: (x["item_id"] is None, x["item_id"])) for h in out]


_indexes: dict[str, Index] = {}


def _scan(docs: DataFrame, items: list[tuple[int, str]], k: int, threshold: float) -> DataFrame:
    """``docs`` as struct ``row``, with the ``hits`` of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    token = f"{id(shared)}-{shared._jbroadcast.id()}"
    packed = docs.withColumn("text", F.col("text").cast("string")).select(F.struct("*").alias("row"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("item_shingles", pa.int64())]))

    def run(batches):
        if token not in _indexes:
            _indexes.clear()
            _indexes[token] = Index(shared.value, k, threshold)
        index = _indexes[token]
        for batch in batches:
            lowered = pc.utf8_lower(pc.fill_null(batch.column(0).field("text"), ""))
            for b in blocks(lowered):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, len(b)), pa.array(index.hits(b), kind)],
                                                 ["row", "hits"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, hits {HITS}")


def _item_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [[(r.item_id, r.text) for r in items.where(F.col("block") == i).collect()] for i in range(n)] if total else []


def search(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, shared, item_shingles, containment)`` for each item
    contained in a document.

    Texts are lower-cased; words are runs of ASCII letters and digits and of
    other than ASCII characters.  An item of fewer than ``k`` words is one shingle,
    looked for at its own length.  Null and wordless items are in no document, and
    null or empty documents hold none.  Repeated documents repeat their rows,
    repeated items do not.  Other columns are ignored."""
    on_workers(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.select("doc_id", F.lit(None).cast(HITS).alias("hits")).where("false")
    for items in _item_blocks(benchmark):
        out = out.union(_scan(docs, items, k, threshold).select("row.doc_id", "hits"))
    return out.select("doc_id", F.explode("hits").alias("h")).select(
        "doc_id", "h.item_id", "h.shared", "h.item_shingles", (F.col("h.shared") / F.col("h.item_shingles")).alias("containment"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; same columns."""
    on_workers(docs.sparkSession)
    for items in _item_blocks(benchmark):
        docs = _scan(docs, items, k, threshold).where(F.size("hits") == 0).select("row.*")
    return docs
