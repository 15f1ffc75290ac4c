"""Substring dedup by Relative Lempel-Ziv parsing.

The reference of a document is all documents with a smaller id.  It is indexed
by content in blocks that live in different tasks:

* A *block key* is the least hash of the ``anchor``-word runs of a window
  (a minimizer).  Equal windows have equal block keys, so a document has to be
  held only against the reference blocks of its own keys, and keys that occur in
  one document only hold no reference.
* A block indexes each stretch of windows it owns (consecutive windows with one
  key) under the stretch's hash, with its first place; stretches that differ are
  indexed again by each single window.  Both indexes keep the first place only,
  by aggregation, so that a passage in a third of all documents stays one row.

Each document is then factored greedily, left to right: a factor begins at the
first window found in the index and is extended while the next window's place
in the reference follows the last one's.  Only factors of at least ``window``
words count.  At a factor boundary the windows that lie across it are looked up
as well (a window may end in one reference text and go on in another), so the
words covered are exactly those of all repeated windows.

Equality of windows and stretches is by two independent 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import (blocks, on_workers, range_hashes, run_hashes, saved, signed, sliding_min,
                                 words_of)

RUNS = "doc_id long, text_id long, key long, stretch long, start int, n int"
WINDOWS = "doc_id long, text_id long, h1 long, h2 long, start int"
FACTOR = "struct<start:int,n:int,ref_doc:bigint,ref_start:int>"


def _stretches(words, block, window: int, anchor: int):
    """Stretches of windows with one key: (doc, start word, windows, key), and
    the word hashes."""
    wh = range_hashes(block.data, words.starts, words.ends)
    grams, _ = run_hashes(wh, words.first, anchor)
    n = max(0, len(wh) - window + 1)
    empty = np.empty(0, np.int64)
    if not n:
        return wh, empty, empty, empty, np.empty(0, np.uint64)
    least = sliding_min(grams, window - anchor + 1)[:n]
    doc = np.searchsorted(words.first, np.arange(n), "right") - 1
    whole = words.first[doc + 1] - np.arange(n) >= window
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(opens)
    stop = np.append(at[1:], n)
    seen = np.concatenate([[0], np.cumsum(whole)])
    return wh, doc[at], at, seen[stop] - seen[at], least[at]


def _runs(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, text_ids = batch.column(0), batch.column(1)
            for b in blocks(batch.column(2)):
                w = words_of(b)
                wh, doc, at, n, key = _stretches(w, b, window, anchor)
                if not len(at):
                    continue
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(doc + b.lo)), text_ids.take(pa.array(doc + b.lo)), pa.array(signed(key)),
                    pa.array(signed(range_hashes(wh, at, at + n + window - 1, 1))),
                    pa.array((at - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["doc_id", "text_id", "key", "stretch", "start", "n"])

    return docs.mapInArrow(run, RUNS)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """``docs(doc_id, text_id, text, todo array<struct<start, n>>)`` -> a row per window."""
    def run(batches):
        for batch in batches:
            ids, text_ids, lists = batch.column(0), batch.column(1), batch.column(3).to_pylist()
            for b in blocks(batch.column(2)):
                w = words_of(b)
                wh = range_hashes(b.data, w.starts, w.ends)
                wh2 = range_hashes(b.data, w.starts, w.ends, 1)
                at = [w.first[d] + x["start"] + np.arange(x["n"]) for d in range(len(b)) for x in lists[b.lo + d]]
                if not at:
                    continue
                at = np.concatenate(at)
                doc = np.searchsorted(w.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(doc + b.lo)), text_ids.take(pa.array(doc + b.lo)),
                    pa.array(signed(range_hashes(wh, at, at + window))),
                    pa.array(signed(range_hashes(wh2, at, at + window, 1))),
                    pa.array((at - w.first[doc]).astype(np.int32))], ["doc_id", "text_id", "h1", "h2", "start"])

    return docs.mapInArrow(run, WINDOWS)


def factors(docs: DataFrame, window: int = 50, anchor: int = 16) -> DataFrame:
    """``docs(doc_id, text_id, text)`` -> ``(doc_id, text_id, start, n, ref_doc,
    ref_start)``: pieces of factors, as ``n`` consecutive windows from word ``start`` on that
    also lie at ``ref_start`` of the smaller ``ref_doc``.  ``text_id`` tells rows of
    one id with different texts apart.  Rows without an id are no reference and
    have none."""
    if not 0 < anchor <= window:
        raise ValueError("the anchor must be at most the window")
    on_workers(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    runs = saved(_runs(docs, window, anchor), "runs")
    shared = saved(runs.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                   .where("lo < hi").select("key"), "keys")
    runs = saved(runs.join(shared, "key", "left_semi"), "shared")
    first = saved(runs.groupBy("key", "stretch").agg(
        F.min(F.struct("doc_id", "start")).alias("ref")), "stretches")
    placed = runs.join(first, ["key", "stretch"])
    long_ones = placed.where("ref.doc_id < doc_id").select(
        "doc_id", "text_id", "start", "n", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start"))
    # Stretches in the first document that has them: held against the block's other stretches by window.
    several = saved(first.groupBy("key").agg(F.min("ref.doc_id").alias("lo"), F.max("ref.doc_id").alias("hi"))
                    .where("lo < hi").select("key"), "several")
    open_ones = placed.where("ref.doc_id = doc_id").join(several, "key", "left_semi") \
        .groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "n")).alias("todo"))
    single = saved(_windows(docs.join(open_ones, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "todo"), window), "windows")
    place = saved(single.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("ref"),
                                                 F.max("doc_id").alias("hi"))
                  .where("ref.doc_id < hi").select("h1", "h2", "ref"), "places")
    short_ones = single.join(place, ["h1", "h2"]).where("ref.doc_id < doc_id").select(
        "doc_id", "text_id", "start", F.lit(1).alias("n"), F.col("ref.doc_id").alias("ref_doc"),
        F.col("ref.start").alias("ref_start"))
    return long_ones.union(short_ones)


def _parse(pieces: list[dict], window: int, n_words: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Greedy factors ``(start, words, ref_doc, ref_start)`` of a document, and
    which of its words they and the windows across their boundaries cover."""
    n_windows = max(0, n_words - window + 1)
    ref_doc = np.zeros(n_windows, np.int64)
    ref_at = np.zeros(n_windows, np.int64)
    found = np.zeros(n_windows, bool)
    for p in pieces:
        a, b = p["start"], p["start"] + p["n"]
        ref_doc[a:b], ref_at[a:b], found[a:b] = p["ref_doc"], np.arange(p["n"]) + p["ref_start"], True
    hit = np.flatnonzero(found)
    if not len(hit):
        return np.zeros(n_words, bool), []
    goes_on = (hit[1:] == hit[:-1] + 1) & (ref_doc[hit[1:]] == ref_doc[hit[:-1]]) & (ref_at[hit[1:]] == ref_at[hit[:-1]] + 1)
    heads = hit[np.flatnonzero(np.concatenate([[True], ~goes_on]))]
    tails = hit[np.flatnonzero(np.concatenate([~goes_on, [True]]))]
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, heads, 1)
    np.add.at(edge, tails + window, -1)
    out = [(int(h), int(t - h) + window, int(ref_doc[h]), int(ref_at[h])) for h, t in zip(heads, tails)]
    return np.cumsum(edge[:-1]) > 0, out


def dedup(docs: DataFrame, window: int = 50, anchor: int = 16, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_words, n_removed, kept_sha256,
    kept, factors)``.

    Words are runs of other than ASCII white space.  A word goes if a window of
    ``window`` words over it also starts in a row with a smaller id; windows are
    judged on the input.  ``kept`` joins the rest by one space, ``factors`` lists
    the parse.  Null and empty texts have no words.  Rows with one id, whether
    their texts are equal or not, do not remove each other; rows without an id stay whole.  Other
    columns are ignored."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    found = factors(docs, window, anchor).groupBy("doc_id", "text_id").agg(
        F.collect_list(F.struct("start", "n", "ref_doc", "ref_start")).alias("pieces"))
    out_type = ("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, "
                "factors array<struct<start:int,n:int,ref_doc:bigint,ref_start:int>>")
    factor = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("ref_doc", pa.int64()),
                                 ("ref_start", pa.int32())]))

    def run(batches):
        for batch in batches:
            ids, pieces = batch.column(0), batch.column(2)
            for b in blocks(batch.column(1)):
                w = words_of(b)
                rows = []
                for d in range(len(b)):
                    lo, hi = w.first[d], w.first[d + 1]
                    doc, starts, ends = b.data[b.offsets[d]:b.offsets[d + 1]], w.starts[lo:hi], w.ends[lo:hi]
                    gone, parsed = np.zeros(hi - lo, bool), []
                    if pieces[b.lo + d].is_valid:
                        gone, parsed = _parse(pieces[b.lo + d].as_py(), window, int(hi - lo))
                    starts, ends = starts[~gone] - b.offsets[d], ends[~gone] - b.offsets[d]
                    # a byte after each kept word but the last becomes the space; all of them are separators
                    edge = np.zeros(len(doc) + 2, np.int8)
                    edge[starts] += 1
                    np.add.at(edge, ends + 1, -1)
                    keep = np.cumsum(edge[:-2]) > 0
                    if len(ends) and ends[-1] < len(doc):
                        keep[ends[-1]] = False
                    text = doc.copy()
                    text[ends[:-1]] = 32
                    kept = text[keep].tobytes()
                    rows.append((int(hi - lo), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(),
                                 [dict(zip(("start", "n", "ref_doc", "ref_start"), f)) for f in parsed]))
                n, removed, sha, kept, parsed = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(b.lo, len(b)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(parsed, factor)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "factors"])

    return docs.join(found, ["doc_id", "text_id"], "left").select("doc_id", "text", "pieces").mapInArrow(run, out_type)
