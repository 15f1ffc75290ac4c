"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A document's paragraphs (its lines) are hashed to 64-bit digests; the i-th
repetition of a paragraph has a digest of its own.  A digest is added to three
cells of a sketch, one in each third of it: a cell holds how many digests it has,
their XOR, and the XOR of their checks.  Sketches of two versions subtract cell by
cell; what both have cancels out.  Cells left with a single digest give it away,
which is then taken out of its other cells, and so on ("peeling"), until the
digests that only one version has are recovered.  If cells remain, the sketches
were too small: both are made anew with twice as many cells.

Long paragraphs are cut further into pieces, by their content: before each place
where the hash of the ``WINDOW`` bytes before it meets a mask (about every 64 bytes),
and every ``LONGEST`` bytes where no such place comes.  So an edit changes only the
pieces near it, also in a text without a line feed.  The cells hold pieces.

All of this runs on whole blocks of documents at a time, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import blocks, mix, on_workers, range_hashes, signed

CELLS = 24
HASHES = 3
LINE_FEED = 10
ROWS_AT_ONCE = 512
WINDOW = 32
CUT_MASK = np.uint64(63)
LONGEST = 256


# --- digests and cells ------------------------------------------------------------------

def _cut(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paragraphs' pieces, ``(start, stop)`` and the paragraph of each."""
    ends = np.arange(WINDOW, len(data))
    meets = np.zeros(len(data) + 1, bool)
    meets[WINDOW:len(data)] = (range_hashes(data, ends - WINDOW, ends) & CUT_MASK) == 0
    at = np.flatnonzero(meets)
    long = np.flatnonzero(stop - start > WINDOW)
    of = np.searchsorted(start[long], at, "right") - 1
    at, of = at[of >= 0], long[of[of >= 0]]
    inside = (at - start[of] >= WINDOW) & (at < stop[of])
    at, of = at[inside], of[inside]
    # not everywhere in a run of one character; a window of another paragraph has no say
    alone = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)])[:len(at)]
    at, of = at[alone], of[alone]
    begin, owner = np.concatenate([start, at]), np.concatenate([np.arange(len(start)), of])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    last = np.concatenate([owner[1:] != owner[:-1], [True]])[:len(owner)]
    end = np.where(last, stop[owner], np.concatenate([begin[1:], [0]])[:len(begin)])
    n = np.maximum(1, -(-(end - begin) // LONGEST))
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(begin, n) + step * LONGEST
    return begin, np.minimum(begin + LONGEST, np.repeat(end, n)), np.repeat(owner, n)


def digests(texts: pa.Array, pieces: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of all texts, or of their pieces, and the text
    that each belongs to."""
    keys, owners = [], []
    for b in blocks(texts):
        ends = np.flatnonzero(b.data == LINE_FEED)
        has = np.flatnonzero(np.diff(b.offsets) > 0)
        # a paragraph ends at a line feed or at the end of a text that is not empty
        stops = np.sort(np.concatenate([ends * 2, b.offsets[1:][has] * 2 - 1]))
        at_end = stops % 2 == 1
        stop = (stops + 1) // 2
        start = np.concatenate([[0], stop[:-1] + ~at_end[:-1]])[:len(stop)]
        owner = np.searchsorted(b.offsets, stop - at_end, "right") - 1
        if pieces:
            start, stop, of = _cut(b.data, start, stop)
            owner = owner[of]
        keys.append(range_hashes(b.data, start, stop))
        owners.append(owner + b.lo)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[:len(key)]
    run = np.flatnonzero(new)
    repeat = np.arange(len(key)) - run[np.cumsum(new) - 1] if len(key) else np.empty(0, np.int64)
    return np.where(repeat > 0, mix(key + repeat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), key), owner


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)


def _places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each digest in each third."""
    third = cells // HASHES
    with np.errstate(over="ignore"):
        return [(mix(keys + np.uint64(j + 1) * np.uint64(0xD1B54A32D192ED03) + np.uint64(cells)) % np.uint64(third)
                 ).astype(np.int64) + j * third for j in range(HASHES)]


class Sketches:
    """The sketches of ``n`` texts: three arrays of ``n * cells``."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def add(self, keys: np.ndarray, owners: np.ndarray, sign: np.ndarray | int = 1) -> "Sketches":
        for place in _places(keys, self.cells):
            at = owners * self.cells + place
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, _check(keys))
        return self

    def subtract(self, other: "Sketches") -> "Sketches":
        out = Sketches(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered digests, their texts and signs; and which texts' cells are
        all empty now."""
        keys, owners, signs = [], [], []
        third = self.cells // HASHES
        while True:
            at = np.flatnonzero((np.abs(self.count) == 1) & (self.check == _check(self.key)))
            key, owner, cell = self.key[at], at // self.cells, at % self.cells
            places = np.stack(_places(key, self.cells)) if len(at) else np.empty((HASHES, 0), np.int64)
            fits = places[cell // third, np.arange(len(at))] == cell
            key, owner, sign = key[fits], owner[fits], self.count[at[fits]]
            if not len(key):
                break
            order = np.lexsort((key, owner))
            key, owner, sign = key[order], owner[order], sign[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            key, owner, sign = key[new], owner[new], sign[new]
            self.add(key, owner, -sign)
            keys.append(key)
            owners.append(owner)
            signs.append(sign)
        left = ((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(self.n, self.cells).any(1)
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return cat(keys, np.uint64), cat(owners, np.int64), cat(signs, np.int64), ~left

    def hex(self) -> list[str]:
        """A text's cells in hexadecimal: count, XOR of digests, XOR of checks."""
        raw = np.empty((self.n * self.cells, 14), np.uint8)
        raw[:, 0:2] = self.count.astype(">u2").view(np.uint8).reshape(-1, 2)
        raw[:, 2:10] = self.key.astype(">u8").view(np.uint8).reshape(-1, 8)
        raw[:, 10:14] = self.check.astype(">u4").view(np.uint8).reshape(-1, 4)
        joined, width = raw.tobytes().hex(), self.cells * 28
        return [joined[i * width:(i + 1) * width] for i in range(self.n)]


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS,
                sketch_a: Sketches | None = None, sketch_b: Sketches | None = None,
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests that only one of each pair of texts has: ``(digest, pair, sign)``,
    sign 1 for the first text's.  ``a`` and ``b`` are digests and pairs."""
    out = []
    todo = np.arange(n)
    (ka, oa), (kb, ob) = a, b
    while True:
        first = sketch_a if sketch_a is not None else Sketches(len(todo), cells).add(ka, oa)
        second = sketch_b if sketch_b is not None else Sketches(len(todo), cells).add(kb, ob)
        key, owner, sign, done = first.subtract(second).peel()
        good = done[owner]
        out.append((key[good], todo[owner[good]], sign[good]))
        if done.all():
            return tuple(np.concatenate(x) for x in zip(*out))
        # larger sketches for the pairs that failed
        sketch_a = sketch_b = None
        cells *= 2
        renumber = np.cumsum(~done) - 1
        keep_a, keep_b = ~done[oa], ~done[ob]
        ka, oa, kb, ob = ka[keep_a], renumber[oa[keep_a]], kb[keep_b], renumber[ob[keep_b]]
        todo = todo[~done]


def likeness(n_a: np.ndarray, pair: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Shared paragraphs (or pieces) out of all of both, 1 for two texts without any."""
    only_a = np.bincount(pair[sign > 0], minlength=len(n_a))
    only_b = np.bincount(pair[sign < 0], minlength=len(n_a))
    either = n_a + only_b
    return np.where(either > 0, (n_a - only_a) / np.maximum(either, 1), 1.0)


# --- operators ----------------------------------------------------------------------------

def compare(pairs: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """Adds to each row the fingerprints of two text columns, their likeness, and
    the digests of the pieces that only one has.  Null texts are empty."""
    on_workers(pairs.sparkSession)
    packed = pairs.select(F.struct("*").alias("row"), F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b"))
    kind = packed.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                n = part.num_rows
                a, b = digests(part.column(1), True), digests(part.column(2), True)
                sa, sb = Sketches(n, CELLS).add(*a), Sketches(n, CELLS).add(*b)
                key, pair, sign = differences(a, b, n, CELLS, sa, sb)
                only = [[sorted(signed(key[(pair == i) & (sign == s)]).tolist()) for i in range(n)] for s in (1, -1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sa.hex()), pa.array(sb.hex()),
                     pa.array(likeness(np.bincount(a[1], minlength=n), pair, sign)),
                     *(pa.array(x, pa.list_(pa.int64())) for x in only)],
                    ["row", "fingerprint_a", "fingerprint_b", "likeness", "only_a", "only_b"])

    return packed.mapInArrow(run, f"row {kind}, fingerprint_a string, fingerprint_b string, likeness double, "
                                  "only_a array<bigint>, only_b array<bigint>")


def in_order(docs: DataFrame, n_ranges: int) -> DataFrame:
    """``docs(doc_id, text)`` cut into ranges of descending ids that lie in one
    partition each, sorted; each range is followed by the row (``after`` 1) that
    comes next, the last one by the first row of all."""
    spark = docs.sparkSession
    docs = docs.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    shares = [i / n_ranges for i in range(1, n_ranges)]
    cuts = sorted({int(x) for x in docs.select("at").approxQuantile("at", shares, 0.2 / n_ranges)}) if shares else []
    lies = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("at"))) if cuts else F.lit(0)
    docs = docs.withColumn("range", lies)
    tops = docs.select("range", "at").groupBy("range").agg(F.max("at").alias("at")).orderBy("range").collect()
    # one row per range: its highest id follows the next range above; the highest of all follows the lowest range
    follow = [(top.at, tops[(i + 1) % len(tops)].range) for i, top in enumerate(tops)]
    follow = F.broadcast(spark.createDataFrame(follow, "top long, follows int"))
    put = F.array(F.struct(F.col("range").cast("int").alias("range"), F.lit(0).alias("after")),
                  F.struct(F.col("follows").cast("int").alias("range"), F.lit(1).alias("after")))
    both = docs.join(follow, F.col("at") == F.col("top"), "left").withColumn(
        "put", F.explode(F.filter(put, lambda p: p["range"].isNotNull())))
    return both.select("doc_id", "text", "at", "put.range", "put.after").repartitionById(max(1, len(cuts) + 1), F.col("range")) \
        .sortWithinPartitions("range", "after", F.desc("at"), "text").select("doc_id", "text", "range", "after")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, as in ``RESULT``.

    A text's edited version has its last half (rounded down) replaced by as many
    of the first code points of the next text, in descending order of id, the
    first one after the last.  Null texts are empty, rows without an id come last
    and rows of one id are ordered by text.  Other columns are ignored.

    ``near_edited`` and ``near_next`` are the shared pieces out of all pieces of
    both texts, from subtracting and peeling the returned fingerprints (larger
    ones where these do not suffice)."""
    spark = docs.sparkSession
    on_workers(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def rows(ids, texts):
        """Result of all rows but the one behind the last, which is only compared to."""
        n = len(ids)
        edited = [t[:len(t) - len(t) // 2] + after[:len(t) // 2] for t, after in zip(texts, texts[1:])]
        own_texts, edited_texts = pa.array(texts, pa.large_string()), pa.array(edited, pa.large_string())
        key, owner = digests(own_texts, True)
        e = digests(edited_texts, True)
        own, after = owner < n, owner >= 1
        a, b = (key[own], owner[own]), (key[after], owner[after] - 1)
        sketches = Sketches(n + 1, CELLS).add(key, owner)
        changed = Sketches(n, CELLS).add(*e)
        first, size = _part(sketches, 0, n), np.bincount(a[1], minlength=n)
        near = [likeness(size, *differences(a, other, n, CELLS, first, sketch)[1:])
                for other, sketch in ((e, changed), (b, _part(sketches, 1, n)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
             pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
             pa.array(first.hex(), pa.string()), pa.array(changed.hex(), pa.string()), *map(pa.array, near)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        ids, texts, of, over = [], [], None, False
        for batch in batches:
            for doc_id, text, part, after in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part != of:
                    ids, texts, of, over = [], [], part, False
                if over:
                    continue  # further rows of the id that follows
                ids.append(doc_id)
                texts.append(text)
                over = after == 1
                if len(ids) > ROWS_AT_ONCE or over:
                    if len(ids) > 1:
                        yield rows(ids[:-1], texts)
                    ids, texts = ids[-1:], texts[-1:]

    if docs.isEmpty():
        return spark.createDataFrame([], RESULT)
    return in_order(docs, n_ranges).mapInArrow(run, RESULT)


def _part(s: Sketches, lo: int, n: int) -> Sketches:
    out = Sketches(0, s.cells)
    span = slice(lo * s.cells, (lo + n) * s.cells)
    out.n, out.count, out.key, out.check = n, s.count[span], s.key[span], s.check[span]
    return out
