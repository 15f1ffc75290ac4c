"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart share a variant: a 64-bit value
at most ``radius / 2`` bits from both.  Every distinct fingerprint emits all its
variants and the variants are shuffled; equal ones make pairs.  The emission is
done in two steps so that the shuffle stays small: a fingerprint is sent once to
each variant *prefix* it reaches, and the receiving task lists the variants
with that prefix.  The set of variants is the same, with no random misses."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import SPACES, blocks, on_workers, saved, signed, words_of
from feedloom.llm.components import star_forest

BITS = 64
SEED = 42
VARIANTS_PER_TASK = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _block_fingerprints(block, k: int) -> np.ndarray:
    """Fingerprints of a block's documents."""
    w = words_of(block, SPACES)
    keep = ~SPACES[block.data]
    more = np.ones(len(w), bool)
    more[w.first[1:][w.first[1:] > w.first[:-1]] - 1] = False  # the last word of a document
    keep[w.ends[more]] = True
    text = _LOWER[block.data]
    text[SPACES[text]] = 32
    at = np.concatenate([[0], np.cumsum(keep)])
    joined = text[keep].tobytes()
    starts, ends = at[w.starts], at[w.ends]
    out = np.zeros(len(block), np.uint64)
    digest = xxhash.xxh64_intdigest
    for d in range(len(block)):
        a, b = w.first[d], w.first[d + 1]
        if a == b:
            continue
        size = min(k, b - a)
        spans = zip(starts[a:b - size + 1].tolist(), ends[a + size - 1:b].tolist())
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[d] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp long)``: lower-case A-Z, words between ASCII white space,
    ``k``-word shingles with repeats (shorter texts: the whole sequence), one
    bit per position set in over half of the shingle hashes.  Null, empty and
    wordless texts have fingerprint 0."""
    on_workers(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            fps = [_block_fingerprints(b, k) for b in blocks(texts)]
            if fps:
                yield pa.RecordBatch.from_arrays([ids, pa.array(signed(np.concatenate(fps)))], ["doc_id", "fp"])

    return narrow.mapInArrow(run, "doc_id long, fp long").withColumnRenamed("doc_id", id_col)


def masks_within(bits: int, flips: int) -> np.ndarray:
    """All masks of at most ``flips`` ones among the lowest ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for n in range(flips + 1) for c in itertools.combinations(range(bits), n)],
                    np.uint64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, for edges ``(a, b)``."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt
    return label


def _bucket_links(fps: np.ndarray, prefix: int, prefix_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints whose variants share this prefix.

    The variants are listed in slices of the next bits, so that memory holds a
    bounded number of them at a time."""
    half, low_bits = radius // 2, BITS - prefix_bits
    fps = np.unique(fps)
    low = fps & np.uint64((1 << low_bits) - 1)
    left = half - np.bitwise_count((fps >> np.uint64(low_bits)) ^ np.uint64(prefix)).astype(int)
    label = np.arange(len(fps))
    masks = {r: masks_within(low_bits, r) for r in range(half + 1)}
    most = sum(int((left == r).sum()) * len(masks[r]) for r in masks)
    slice_bits = min(low_bits, max(0, math.ceil(math.log2(max(1, most / (2 * VARIANTS_PER_TASK))))))
    shift = np.uint64(low_bits - slice_bits)
    top_masks = {r: masks[r] >> shift for r in masks}
    a_all, b_all = [], []
    for part in range(1 << slice_bits):
        vs, owners = [], []
        for r, ms in masks.items():
            own = np.flatnonzero(left == r)
            if not slice_bits:
                vs.append((low[own][:, None] ^ ms).ravel())
                owners.append(np.repeat(own, len(ms)))
                continue
            gap = (low[own] >> shift) ^ np.uint64(part)
            for top in np.unique(top_masks[r]):
                sel, use = own[gap == top], ms[top_masks[r] == top]
                if len(sel):
                    vs.append((low[sel][:, None] ^ use).ravel())
                    owners.append(np.repeat(sel, len(use)))
        if not vs:
            continue
        v, o = np.concatenate(vs), np.concatenate(owners)
        order = np.argsort(v)
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        a, b = o[same], o[same + 1]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        pairs = np.unique(np.minimum(a[near], b[near]) * len(fps) + np.maximum(a[near], b[near]))
        a_all.append(pairs // max(1, len(fps)))
        b_all.append(pairs % max(1, len(fps)))
    if a_all:
        label = _forest(len(fps), np.concatenate(a_all), np.concatenate(b_all))
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[child]], fps[child]


def links(nodes: DataFrame, radius: int = 4, prefix_bits: int | None = None) -> DataFrame:
    """``nodes(fp)`` distinct -> ``(a, b)``: links that connect exactly the
    fingerprints that chains of at most ``radius`` differing bits connect."""
    if radius % 2 or not 0 <= radius <= 8:
        raise ValueError("the radius must be even and at most 8")
    spark = nodes.sparkSession
    on_workers(spark)
    half = radius // 2
    if prefix_bits is None:
        n = nodes.count()
        total = max(1, n) * len(masks_within(BITS, half)) if half < 3 else max(1, n) * math.comb(BITS, half)
        prefix_bits = min(28, max(6, math.ceil(math.log2(total / VARIANTS_PER_TASK))))

    def route(batches):
        reach = masks_within(prefix_bits, half)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                top = fp.view(np.uint64) >> np.uint64(BITS - prefix_bits)
                to = (top[:, None] ^ reach).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.astype(np.int64)), pa.array(np.repeat(fp, len(reach)))], ["bucket", "fp"])

    def meet(key, table):
        bucket = key[0].as_py()
        fps = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        a, b = _bucket_links(fps, bucket, prefix_bits, radius)
        return pa.table({"a": signed(a), "b": signed(b)})

    routed = nodes.select("fp").mapInArrow(route, "bucket long, fp long")
    return routed.groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fp, fingerprint, component_id)``.

    ``fingerprint`` is ``fp`` as 16 lower-case hex digits; ``component_id`` is
    the smallest doc_id reachable over links of at most ``radius`` bits (null
    only where no member has an id).  Copies share a fingerprint and are
    collapsed before the search; no pair between copies is made.  Repeated rows
    give repeated rows, an empty table gives none, other columns are ignored."""
    fps = saved(fingerprints(docs, k, id_col, text_col).withColumnRenamed(id_col, "doc_id"), "fps")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    stars = star_forest(links(nodes, radius))
    rooted = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    rooted = saved(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = saved(rooted.join(least, "root").select("fp", "component_id"), "labels")
    return fps.join(labels, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def repeated_ids(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id)``: the ids that are not the smallest of their component, once each."""
    return near_duplicates(docs, k, radius).where("doc_id <> component_id").select("doc_id").distinct()


def keep_one(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; same
    columns.  Rows without an id stay, and so do all rows of the id that is kept
    (repeated rows are one document)."""
    ids = repeated_ids(docs, k, radius).select(F.col("doc_id").alias("of"))
    return docs.join(ids, docs["doc_id"] == ids["of"], "left_anti")
