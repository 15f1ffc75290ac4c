"""Conversation prefix trie from sorted neighbours, without a tree or a stack.

Conversations are sorted by their turns, so that all that begin alike lie side by
side, and each keeps the length of the longest common prefix (LCP) with the one
before.  A prefix is named once, by the first row that has it.  Over the LCPs of a
block of rows lies a sparse table of range minima: every prefix of ``d`` turns
searches it by halving steps to the left and to the right, on its own, for as long
as the minimum is at least ``d``.  The rows between are its members.  Everything else
is a difference of running sums over that interval: turns and leaves below it, what
its members' turns weigh, what the trie keeps of them.

On Spark:

* Turns are numbered over ranges of (conv_id, turn), so a very long conversation is
  many rows of many tasks.  Only 128-bit hashes and lengths of turns go on.
* A row holds a *segment*, ``segment`` turns of one conversation, and the hash of all
  turns before; segments sort by number, that hash, and their turns.  So rows have a
  bounded size, and conversations that differ early share no later block.
* The order is by range, with the conversation's id last, so equal conversations
  spread over ranges.  Blocks of ``block_rows`` neighbours are searched each on its
  own; parts of a prefix that lies across blocks are added up by its hash.  LCPs at
  the ranges' edges come from the first and last row of each range.
* What later segments of a conversation hold (running sums by conversation, narrow
  rows of long conversations only) counts in its earlier ones."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.llm.common import on_workers, saved

SEGMENT = 64
BLOCK_ROWS = 1 << 13
NONE = hashlib.sha256(b"").hexdigest()


# --- turns of rebuilt conversations -----------------------------------------------------

def numbered(turns: DataFrame) -> DataFrame:
    """``(conv_id, place, a, b, chars)``: turns numbered from 1 by turn (null
    first), equal ones by the hash of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    order = ["conv_id", "turn", "a", "b"]
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), role, text).alias("b"), F.length(text).cast("long").alias("chars"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "conv_id", "a", "b", "chars")

    def run(batches):
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(1).to_numpy()
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            heads = np.flatnonzero(new)
            start = np.concatenate([[-seen], heads])[np.cumsum(new)]
            place = np.arange(len(conv)) - start + 1
            last, seen = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "at"])

    rows = saved(rows.mapInArrow(run, "part int, conv_id long, a long, b long, chars long, at long"), "turns")
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # A range edge cuts one conversation at most, so there are fewer of these rows than ranges.
    moved = rows.groupBy("conv_id", "part").agg(F.max("at").alias("n")).withColumn("ahead", F.sum("n").over(before)) \
        .where("ahead > 0").select("conv_id", "part", "ahead")
    return rows.join(F.broadcast(moved), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("ahead", F.lit(0))).alias("place"), "a", "b", "chars")


def rebuilt(turns: DataFrame, per_base: int = 100, heads: int = 6) -> DataFrame:
    """``(conv_id, length, depth, a, b, chars)``: of each conversation ``c`` the
    first ``h = crc32(c) % heads`` turns of the conversation ``c - c % per_base``, then
    its own turns after its first ``h``.  One without a turn is a row of depth null."""
    own = saved(numbered(turns), "numbered-turns")
    n = saved(own.groupBy("conv_id").agg(F.max("place").alias("n")), "lengths")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    convs = n.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % per_base).alias("base"))
    base_n = n.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    given = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = saved(convs.join(base_n, "base", "left").select(
        "conv_id", "base", "h", given.alias("given"), (given + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "convs")
    taken = own.where(F.col("place") < heads).select(F.col("conv_id").alias("base"), "place", "a", "b", "chars") \
        .join(convs.where("given > 0"), "base").where("place <= given") \
        .select("conv_id", "length", F.col("place").alias("depth"), "a", "b", "chars")
    kept = own.join(convs, "conv_id").where("place > h").select(
        "conv_id", "length", (F.col("place") - F.col("h") + F.col("given")).alias("depth"), "a", "b", "chars")
    none = [F.lit(None).cast("long").alias(c) for c in ("depth", "a", "b", "chars")]
    return taken.union(kept).union(convs.where("length = 0").select("conv_id", "length", *none))


# --- sorted segments with their LCPs ----------------------------------------------------

def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """``(conv_id, seg, more, p1, p2, x1, x2, turns)``: ``p`` is the hash of all turns
    before the segment, ``x`` that of its own; a hash of turns is the XOR of theirs,
    which hold their depth."""
    g = [F.xxhash64("depth", "a", "b").alias("g1"), F.xxhash64(F.lit(1), "depth", "a", "b").alias("g2")]
    seg = F.coalesce(F.expr(f"(depth - 1) div {segment}"), F.lit(0))
    rows = turns.select("conv_id", "length", seg.alias("seg"), "depth", *g, "chars")
    turn = F.when(F.col("depth").isNotNull(), F.struct("depth", "g1", "g2", "chars"))
    xor = lambda c: F.coalesce(F.bit_xor(F.when(F.col("depth").isNotNull(), F.col(c))), F.lit(0))
    rows = saved(rows.groupBy("conv_id", "seg").agg(
        (F.max("length") > (F.col("seg") + 1) * segment).alias("more"), xor("g1").alias("x1"), xor("g2").alias("x2"),
        F.sort_array(F.collect_list(turn)).alias("turns")), "segments")
    single = rows.where("seg = 0").select("*", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
    before = W.partitionBy("conv_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    ahead = rows.where("more or seg > 0").select("conv_id", "seg", *(F.bit_xor(f"x{i}").over(before).alias(f"p{i}") for i in (1, 2)))
    return single.union(rows.where("seg > 0").join(ahead, ["conv_id", "seg"]).select(*single.columns))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin among them."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return values, offsets - offsets[0]


def _lcps(seg, p1, p2, g1: np.ndarray, g2: np.ndarray, off: np.ndarray) -> np.ndarray:
    """LCP of each row but the first with the row before; -1 where these have no
    common prefix hash or other segment numbers."""
    n = np.diff(off)
    most = np.minimum(n[1:], n[:-1])
    row = np.repeat(np.arange(len(most)), most)
    e = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
    here, there = off[1:-1][row] + e, off[:-2][row] + e
    out = most.copy()
    differ = np.flatnonzero((g1[here] != g1[there]) | (g2[here] != g2[there]))
    np.minimum.at(out, row[differ], e[differ])
    apart = (seg[1:] != seg[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
    return np.where(apart, -1, out)


_ROW = "part int, seg long, p1 long, p2 long, more boolean, conv_id long, g1 array<bigint>, g2 array<bigint>, chars array<bigint>"


def _neighbours(segments: DataFrame, block_rows: int) -> DataFrame:
    """Sorted segments with ``at`` (row of the range), ``block``, ``lcp`` with the row
    before and ``next`` with the row after, -1 at the table's ends."""
    spark = segments.sparkSession
    key = F.transform("turns", lambda t: F.struct(t["g1"].alias("g1"), t["g2"].alias("g2")))
    order = ["seg", "p1", "p2", "key", "more", "conv_id"]
    rows = segments.withColumn("key", key).repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "seg", "p1", "p2", "more", "conv_id",
        *(F.col(f"turns.{c}").alias(c) for c in ("g1", "g2", "chars")))

    def run(batches):
        tail, at, before = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if tail is not None:
                batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            seg, p1, p2 = (batch.column(c).to_numpy() for c in ("seg", "p1", "p2"))
            (g1, off), (g2, _) = _flat(batch.column("g1")), _flat(batch.column("g2"))
            lcps = _lcps(seg, p1, p2, g1, g2, off).tolist()
            if len(lcps):
                yield annotated(batch.slice(0, len(lcps)), at, [before, *lcps[:-1]], lcps)
                at, before = at + len(lcps), lcps[-1]
            tail = batch.slice(batch.num_rows - 1)
        if tail is not None:
            yield annotated(tail, at, [before], [None])

    def annotated(batch, at, lcp, after):
        place = np.arange(at, at + batch.num_rows)
        more = [pa.array(place), pa.array((place // block_rows).astype(np.int32)), pa.array(lcp, pa.int64()), pa.array(after, pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "at", "block", "lcp", "next"])

    rows = saved(rows.mapInArrow(run, f"{_ROW}, at long, block int, lcp long, next long"), "neighbours")
    # The first and the last row of each range: bounded by the number of ranges and the segment.
    ends = rows.where("lcp is null or next is null").select("part", "at", "seg", "p1", "p2", "g1", "g2") \
        .orderBy("part", "at").collect()
    edges = [(ends[0].part, "lcp", -1), (ends[-1].part, "next", -1)] if ends else []
    for a, b in zip(ends, ends[1:]):
        if a.part == b.part:
            continue
        same = (a.seg, a.p1, a.p2) == (b.seg, b.p1, b.p2)
        pairs = list(zip(a.g1, a.g2)), list(zip(b.g1, b.g2))
        lcp = next((i for i, (x, y) in enumerate(zip(*pairs)) if x != y), min(map(len, pairs))) if same else -1
        edges += [(a.part, "next", lcp), (b.part, "lcp", lcp)]
    edges = spark.createDataFrame(edges, "part int, side string, v long").groupBy("part").agg(
        F.max(F.when(F.col("side") == "lcp", F.col("v"))).alias("edge_lcp"), F.max(F.when(F.col("side") == "next", F.col("v"))).alias("edge_next"))
    return rows.join(F.broadcast(edges), "part").withColumns(
        {"lcp": F.coalesce("lcp", "edge_lcp"), "next": F.coalesce("next", "edge_next")}).drop("edge_lcp", "edge_next")


# --- intervals ----------------------------------------------------------------------------

class SparseTable:
    """Minima over all ranges of ``2**k`` values, by first value."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (width := 1 << len(self.levels)) <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-(width // 2)], below[width // 2:]))

    def minimum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over ``low..high``, both included."""
        out = np.empty(len(low), self.levels[0].dtype)
        k = np.frexp((high - low + 1).astype(float))[1] - 1
        for level in np.unique(k):
            own = k == level
            t = self.levels[level]
            out[own] = np.minimum(t[low[own]], t[high[own] - (1 << level) + 1])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Farthest ``r`` such that all values after ``at`` up to ``r`` are ``least`` or more."""
        out = at.copy()
        for k in reversed(range(len(self.levels))):
            t = self.levels[k]
            fits = out + 1 < len(t)
            fits[fits] = t[out[fits] + 1] >= least[fits]
            out[fits] += 1 << k
        return out

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Farthest ``l`` such that all values after ``l`` up to ``at`` are ``least`` or more."""
        out = at.copy()
        for k in reversed(range(len(self.levels))):
            first = out + 1 - (1 << k)
            fits = first >= 1
            fits[fits] = self.levels[k][first[fits]] >= least[fits]
            out[fits] -= 1 << k
        return out


FRAGMENT = ("depth long, k1 long, k2 long, up1 long, up2 long, n long, conv_id long, weight long, opened long, "
            "leaves long, children long")


def _intervals(rows: dict[str, np.ndarray], g1, g2, chars, off: np.ndarray, segment: int) -> list[np.ndarray]:
    """The prefixes of a block's rows, as columns of ``FRAGMENT``."""
    n = np.diff(off)
    lcp, seg = rows["lcp"], rows["seg"]
    table, least_id = SparseTable(lcp), SparseTable(rows["conv_id"])

    # prefixes that a row is the first in the block to have
    low = np.maximum(lcp + 1, seg > 0)
    low[0] = seg[0] > 0
    several = np.maximum(0, n - low + 1)
    row = np.repeat(np.arange(len(n)), several)
    d = np.arange(len(row)) - np.repeat(np.cumsum(several) - several, several) + low[row]
    a, b = table.left(row, d), table.right(row, d)

    hashes = []
    for g, p in ((g1, rows["p1"]), (g2, rows["p2"])):
        upto = np.concatenate([[0], np.bitwise_xor.accumulate(g)]) if len(g) else np.zeros(1, np.int64)
        at = lambda depth: upto[off[row] + depth] ^ upto[off[row]] ^ p[row]  # noqa: B023, E731
        hashes.append((at(d), at(np.maximum(d - 1, 0))))
    sums = np.concatenate([[0], np.cumsum(chars)])
    begin, stop = sums[off[:-1]], sums[off[1:]]
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    weight = total(stop - begin + rows["deep_weight"])
    new = stop - sums[off[:-1] + np.minimum(n, np.maximum(lcp, 0))] + rows["deep_opened"]
    opened = total(new)
    leaf = total((~rows["more"] & (rows["next"] < n)) + rows["deep_leaves"])
    deeper = total(rows["deep_opens"])
    # rows that open a turn after a prefix of that length, by length and place
    opens = np.sort((lcp * len(n) + np.arange(len(n)))[n > lcp])
    within = np.searchsorted(opens, d * len(n) + b, "right") - np.searchsorted(opens, d * len(n) + a, "right")
    first = (lcp[a] <= d) & (n[a] > d)
    children = within + first + np.where(d == segment, deeper[b + 1] - deeper[a], 0)
    count = b - a + 1
    own_first = stop[a] - sums[off[a] + np.maximum(np.maximum(d - 1, lcp[a]), 0)] + rows["deep_opened"][a]
    return [seg[row] * segment + d, hashes[0][0], hashes[1][0], hashes[0][1], hashes[1][1], count, least_id.minimum(a, b),
            weight[b + 1] - weight[a] - count * (sums[off[row] + np.maximum(d - 1, 0)] - begin[row]),
            opened[b + 1] - opened[a + 1] + own_first, leaf[b + 1] - leaf[a], children]


def _fragments(rows: DataFrame, segment: int) -> DataFrame:
    """The parts of all prefixes, a row per prefix and block."""
    after = rows.where("seg > 0").select(
        "conv_id", "seg", F.aggregate("chars", F.lit(0).cast("long"), lambda s, c: s + c).alias("weight"),
        F.aggregate(F.slice("chars", F.greatest(F.lit(0), F.col("lcp")).cast("int") + 1, segment), F.lit(0).cast("long"),
                    lambda s, c: s + c).alias("opened"),
        (~F.col("more") & (F.col("next") < F.size("chars"))).cast("long").alias("leaves"), (F.col("lcp") < 1).cast("long").alias("opens"))
    onwards = W.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(W.unboundedPreceding, W.currentRow)
    deep = after.select("conv_id", (F.col("seg") - 1).alias("seg"), F.col("opens").alias("deep_opens"),
                        *(F.sum(c).over(onwards).alias(f"deep_{c}") for c in ("weight", "opened", "leaves")))
    values = ["deep_weight", "deep_opened", "deep_leaves", "deep_opens"]
    rows = rows.join(deep, ["conv_id", "seg"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in values})
    names = ["seg", "p1", "p2", "more", "conv_id", "lcp", "next", *values]
    columns = FRAGMENT.split(", ")

    def run(key, table):
        table = table.sort_by("at").combine_chunks()
        own = {c: table.column(c).to_numpy() for c in names}
        (g1, off), (g2, _), (chars, _) = (_flat(table.column(c).combine_chunks()) for c in ("g1", "g2", "chars"))
        out = _intervals(own, g1, g2, chars, off, segment)
        return pa.table([pa.array(x, pa.int64()) for x in out], [c.split(" ")[0] for c in columns])

    return rows.groupBy("part", "block").applyInArrow(run, FRAGMENT)


# --- members that end at a node -------------------------------------------------------------

def id_digests(ends: DataFrame) -> DataFrame:
    """``ends(k1, k2, conv_id)`` -> ``(k1, k2, ends_sha256)`` of the ids in ascending
    order, joined by commas.  Ranges of the order join their ids first; a digest
    then reads such pieces one after the other."""
    order = ["k1", "k2", "conv_id"]
    key = "k1 long, k2 long"

    def join(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, ids = (batch.column(i).to_numpy() for i in range(3))
            heads = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            texts = [",".join(map(str, x.tolist())) for x in np.split(ids, heads[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(k1[heads]), pa.array(k2[heads]), pa.array(ids[heads]), pa.array(texts, pa.string())],
                                             ["k1", "k2", "first", "ids"])

    def digest(batches):
        now, h = None, None
        for batch in batches:
            done = []
            for k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) == now:
                    h.update(b",")
                else:
                    if now is not None:
                        done.append((*now, h.hexdigest()))
                    now, h = (k1, k2), hashlib.sha256()
                h.update(ids.encode())
            if done:
                yield result(done)
        if now is not None:
            yield result([(*now, h.hexdigest())])

    def result(done):
        a, b, sha = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())],
                                          ["k1", "k2", "ends_sha256"])

    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, f"{key}, first long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def trie(turns: DataFrame, segment: int = SEGMENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The nodes of the trie of ``turns(conv_id, depth, a, b, chars, length)`` as from
    ``rebuilt``: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``."""
    on_workers(turns.sparkSession)
    segments = saved(_segments(turns, segment), "prefixed-segments")
    fragments = _fragments(saved(_neighbours(segments, block_rows), "rows"), segment)
    nodes = saved(fragments.groupBy("depth", "k1", "k2").agg(
        F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"),
        (F.sum("weight") - F.sum("opened")).alias("saved_tokens")), "nodes")
    ends = segments.where("not more").select(*(F.expr(f"p{i} ^ x{i}").alias(f"k{i}") for i in (1, 2)), "conv_id")
    nodes = saved(nodes.join(id_digests(ends), ["k1", "k2"], "left"), "digested-nodes")
    root = nodes.where("depth = 0").first()
    parents = nodes.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    # The root is the parent of any number of nodes; other parents' rows are split at run time where they are very many.
    top = F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None)).cast("long")
    rows = nodes.where("depth < 2").withColumn("parent_conv_id", top).unionByName(
        nodes.where("depth > 1").join(parents, ["up1", "up2"]).select(*nodes.columns, "parent_conv_id"))
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, **parameters) -> DataFrame:
    """The trie of the rebuilt ``conversations(conv_id, turn, role, text)``.

    Null roles and texts count as empty ones, turns of null come first and turns of
    one number in the order of a hash of role and text (repeated rows are turns of
    their own).  Rows without a conv_id belong to no conversation.  A conversation
    that has no turn once rebuilt ends at the root.  An empty table has no nodes,
    other columns are ignored."""
    on_workers(conversations.sparkSession)
    return trie(rebuilt(conversations.select("conv_id", "turn", "role", "text")), **parameters)
