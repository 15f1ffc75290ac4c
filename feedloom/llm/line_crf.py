"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is good or bad.  A line speaks for itself by its features
(shares of kinds of characters and words, lengths, repetition) and by those of the
line before and after; a line's label depends on its neighbours' labels by a table
of transitions.  Forward and backward messages give each line's marginal
probability of being good; their mean, weighted by the lines' lengths, is the raw
quality of the text, which a logistic curve turns into the probability of label 1.

Messages are products of 2x2 matrices.  They are made for all lines of a block of
texts at once by doubling: after ``k`` steps a line knows the product of the ``2**k``
matrices up to it, so a text of many lines takes few steps.

Labels are of texts, so in training all lines of a text have its label.  Training
uses a bounded sample, about ``per_class`` labelled rows of each class, chosen by a
hash of doc_id; a quarter of it fits the curve.  The features of the sample lie in a
table; each step of the optimiser (L-BFGS) is a Spark job that sums likelihood and
gradient over it, so only the parameters are on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import SPACES, blocks, on_workers, range_hashes, saved, words_of

LINE_FEED = 10
PER_CLASS = 1500
RIDGE = 0.05
STEPS = 30
THRESHOLD = 0.7
BLOCK_BYTES = 1 << 20
MAX_SPAN = 12.0  # raw log-odds are cut to this on both sides before the curve

# Kinds of bytes; the rest of ASCII (quotes, brackets, hyphens, control characters) is the last kind.
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", ".,;:?", "!", "|", "#$%&*@^~<>=+_\\/{}"]
_KIND = np.full(256, len(_KINDS), np.uint8)
for _i, _chars in enumerate(_KINDS):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _i
_KIND[128:] = 0  # letters beyond ASCII
LOWER, UPPER, DIGIT, BLANK, STOP, SHOUT, PIPE, SIGN = range(8)


# --- lines and features -----------------------------------------------------------------

@dataclass
class Lines:
    """Lines of a block: byte ranges; text ``d`` has lines ``first[d]..first[d + 1]``,
    one at least (an empty text is one empty line)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def lines_of(block) -> Lines:
    feeds = np.flatnonzero(block.data == LINE_FEED)
    starts = np.concatenate([block.offsets[:-1], feeds + 1])
    ends = np.concatenate([block.offsets[1:], feeds])
    owner = np.concatenate([np.arange(len(block)), np.searchsorted(block.offsets, feeds, "right") - 1])
    order = np.lexsort((starts, owner))
    first = np.searchsorted(owner[order], np.arange(len(block) + 1))
    ends_of = np.lexsort((ends, owner))
    return Lines(starts[order], ends[ends_of], first)


def _shares(total: np.ndarray, of: np.ndarray) -> np.ndarray:
    return total / np.maximum(of, 1)


def _own_features(block, lines: Lines) -> np.ndarray:
    """A row per line."""
    n_lines, size = len(lines.starts), lines.ends - lines.starts
    kind = _KIND[block.data]
    columns = []
    for k in range(len(_KINDS) + 1):
        upto = np.concatenate([[0], np.cumsum(kind == k)])
        columns.append(_shares(upto[lines.ends] - upto[lines.starts], size))
    words = words_of(block, SPACES)
    line = np.searchsorted(lines.starts, words.starts, "right") - 1
    # of lines that begin at one place (empty texts) the word is in the last, which holds it
    count = np.bincount(line, minlength=n_lines).astype(float)
    length = words.ends - words.starts
    mean = _shares(np.bincount(line, length, n_lines), count)
    spread = np.sqrt(np.maximum(0, _shares(np.bincount(line, length.astype(float) ** 2, n_lines), count) - mean**2))
    h = range_hashes(block.data, words.starts, words.ends)
    again = np.zeros(len(words), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((h, line))
    new = np.ones(len(words), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=n_lines)
    signs = np.concatenate([[0], np.cumsum((kind == SIGN) | (kind == PIPE) | (kind == SHOUT))])
    signed = signs[words.ends] > signs[words.starts]
    upper = kind[words.starts] == UPPER if len(words) else np.zeros(0, bool)
    for mark in (again, signed, upper, length <= 1):
        columns.append(_shares(np.bincount(line, mark, n_lines), count))
    columns.append(1 - _shares(distinct, np.maximum(count, 1)) - (count == 0))
    last = np.where(size > 0, kind[np.maximum(lines.ends - 1, 0)] if len(kind) else 0, BLANK)
    columns += [last == STOP, last == SHOUT, count == 0, np.log1p(size) / 8, np.log1p(count) / 6, np.minimum(mean, 40) / 10,
                np.minimum(spread, 40) / 10]
    # lines that the text has elsewhere too, and right before
    owner = np.repeat(np.arange(len(block)), np.diff(lines.first))
    lh = range_hashes(block.data, lines.starts, lines.ends)
    order = np.lexsort((lh, owner))
    new = np.ones(n_lines, bool)
    new[1:] = (lh[order][1:] != lh[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    copies = np.empty(n_lines)
    copies[order] = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    before = np.zeros(n_lines, bool)
    before[1:] = (lh[1:] == lh[:-1]) & (owner[1:] == owner[:-1])
    columns += [(copies > 1) & (count > 0), before & (count > 0), np.minimum(np.log(copies), 5) / 5 * (count > 0)]
    return np.stack([np.asarray(c, np.float32) for c in columns], 1)


OWN = len(_KINDS) + 1 + 5 + 7 + 3
WIDTH = 1 + 3 * OWN + 2
N_PARAMETERS = WIDTH + 4


def features(block, lines: Lines) -> np.ndarray:
    """A row per line: 1, its own features, those of the line before and of the line
    after (0 at the ends of a text), and whether there are such lines."""
    own = _own_features(block, lines)
    n = len(own)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, 0] = 1
    out[:, 1:1 + OWN] = own
    has_before, has_after = np.ones(n, bool), np.ones(n, bool)
    has_before[lines.first[:-1]] = False
    has_after[lines.first[1:] - 1] = False
    out[1:, 1 + OWN:1 + 2 * OWN] = own[:-1] * has_before[1:, None]
    out[:-1, 1 + 2 * OWN:1 + 3 * OWN] = own[1:] * has_after[:-1, None]
    out[:, -2], out[:, -1] = ~has_before, ~has_after
    return out


# --- messages -----------------------------------------------------------------------------

def _products(m: np.ndarray, place: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of the matrices of a chain up to each line, scaled to a maximum of
    1, and the logarithms of the scales.  ``place`` counts a line in its chain."""
    p, log = m.copy(), np.zeros(len(m))
    step = 1
    while step < span:
        at = np.flatnonzero(place >= step)
        # a line's product goes on where that of the line `step` before it ends
        a, b = p[at - step], p[at]
        c = np.stack([a[:, 0, 0] * b[:, 0, 0] + a[:, 0, 1] * b[:, 1, 0], a[:, 0, 0] * b[:, 0, 1] + a[:, 0, 1] * b[:, 1, 1],
                      a[:, 1, 0] * b[:, 0, 0] + a[:, 1, 1] * b[:, 1, 0], a[:, 1, 0] * b[:, 0, 1] + a[:, 1, 1] * b[:, 1, 1]], 1)
        top = c.max(1)
        log[at] = log[at] + log[at - step] + np.log(top)
        p[at] = (c / top[:, None]).reshape(-1, 2, 2)
        step *= 2
    return p, log


@dataclass
class Chains:
    """Marginals of the lines of a block."""

    good: np.ndarray   # probability of each line being good
    pairs: np.ndarray  # of labels (before, own), zero at a text's first line
    log_z: np.ndarray  # per text, up to ``shift``
    shift: np.ndarray  # per line: logarithm taken out of its matrix


def chains(score: np.ndarray, table: np.ndarray, first: np.ndarray) -> Chains:
    """``score`` is a line's log-odds of good without its neighbours' labels, and
    ``table[a, b]`` the log-weight of label ``b`` after ``a`` (1 is good)."""
    n = len(score)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    span = int(np.diff(first).max(initial=0))
    raw = np.zeros((n, 2, 2))
    raw[:, :, 1] = score[:, None]
    raw[place > 0] += table
    shift = raw.max((1, 2))
    m = np.exp(raw - shift[:, None, None])
    forward, log = _products(m, place, span)
    alpha = forward[:, 0]  # rows are equal: a chain's first matrix has equal rows
    back = np.repeat(first[1:], np.diff(first)) - 1 - np.arange(n)
    turned, _ = _products(m[::-1].transpose(0, 2, 1), back[::-1], span)
    suffix = turned[::-1].transpose(0, 2, 1)
    beta = np.ones((n, 2))
    inner = np.flatnonzero(back > 0)
    beta[inner] = suffix[inner + 1].sum(2)
    both = alpha * beta
    good = both[:, 1] / both.sum(1)
    pairs = np.zeros((n, 2, 2))
    at = np.flatnonzero(place > 0)
    joint = alpha[at - 1][:, :, None] * m[at] * beta[at][:, None, :]
    pairs[at] = joint / joint.sum((1, 2), keepdims=True)
    ends = first[1:] - 1
    return Chains(good, pairs, log[ends] + np.log(alpha[ends].sum(1)), shift)


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of texts whose lines all have the label ``y`` of the text, and
    its gradient; a text's share is divided by its number of lines, so that long
    texts do not outweigh the others."""
    w, table = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    n = np.diff(first)
    score = x @ w
    c = chains(score, table, first)
    shifts = np.add.reduceat(c.shift, first[:-1])
    path = y * np.add.reduceat(score, first[:-1]) + (n - 1) * table[y, y]
    share = 1 / n
    value = ((path - c.log_z - shifts) * share).sum()
    each = np.repeat(share, n)
    gradient = np.empty(N_PARAMETERS)
    gradient[:WIDTH] = x.T @ ((np.repeat(y, n) - c.good) * each)
    told = np.zeros((2, 2))
    for label in (0, 1):
        told[label, label] = ((n - 1) * share)[y == label].sum()
    gradient[WIDTH:] = (told - (c.pairs * each[:, None, None]).sum(0)).ravel()
    return float(value), gradient


# --- training -------------------------------------------------------------------------------

@dataclass
class Model:
    theta: np.ndarray
    curve: tuple[float, float]  # log-odds of label 1 are slope * raw log-odds + offset

    def lines(self, block, lines: Lines) -> np.ndarray:
        x = features(block, lines)
        return chains(x @ self.theta[:WIDTH], self.theta[WIDTH:].reshape(2, 2), lines.first).good

    def raw(self, lines: Lines, good: np.ndarray) -> np.ndarray:
        """Per text: log-odds of the length-weighted mean of its lines."""
        weight = lines.ends - lines.starts + 1.0
        mean = np.add.reduceat(good * weight, lines.first[:-1]) / np.add.reduceat(weight, lines.first[:-1])
        return np.clip(np.log(np.maximum(mean, 1e-12)) - np.log(np.maximum(1 - mean, 1e-12)), -MAX_SPAN, MAX_SPAN)

    def quality(self, raw: np.ndarray) -> np.ndarray:
        slope, offset = self.curve
        return 1 / (1 + np.exp(-(slope * raw + offset)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``(text, y, weight, calibrate)``; ``weight`` is how many rows one stands for."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")) \
        .where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, min(1.0, per_class / n.get(1, 1))).otherwise(min(1.0, per_class / n.get(0, 1)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.withColumn("share", share).where(draw < F.col("share") * (1 << 30))
    # About per_class rows of each class, whatever the number of labels.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(docs.join(F.broadcast(chosen), "doc_id").select(
        "text", "y", (1 / F.col("share")).alias("weight"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("calibrate")),
        "quality-sample")


def _feature_table(sample: DataFrame) -> DataFrame:
    """A row per block of texts: its features, labels and line numbers, as bytes."""
    def run(batches):
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(0), BLOCK_BYTES):
                lines = lines_of(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()], pa.binary()) for a in
                     (features(b, lines), y[b.lo:b.hi].astype(np.int64), lines.first.astype(np.int64))], ["x", "y", "first"])

    return saved(sample.select("text", "y").mapInArrow(run, "x binary, y binary, first binary"), "line-features")


def _gradient_job(table: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray]:
    def run(batches):
        value, gradient = 0.0, np.zeros(N_PARAMETERS)
        for batch in batches:
            for x, y, first in zip(*(c.to_pylist() for c in batch.columns)):
                v, g = likelihood(theta, np.frombuffer(x, np.float32).reshape(-1, WIDTH), np.frombuffer(y, np.int64), np.frombuffer(first, np.int64))
                value, gradient = value + v, gradient + g
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([gradient.tobytes()], pa.binary())], ["value", "gradient"])

    rows = table.mapInArrow(run, "value double, gradient binary").collect()  # one row per partition
    return sum(r.value for r in rows), sum((np.frombuffer(r.gradient) for r in rows), np.zeros(N_PARAMETERS))


def minimise(function, start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving; ``function`` gives a value and its gradient."""
    at, (value, gradient) = start, function(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, used = gradient.copy(), []
        for s, d in reversed(moves):
            a = s @ direction / (s @ d)
            direction -= a * d
            used.append(a)
        if moves:
            s, d = moves[-1]
            direction *= (s @ d) / (d @ d)
        else:
            direction /= max(1.0, np.abs(direction).sum())
        for (s, d), a in zip(moves, reversed(used)):
            direction += (a - d @ direction / (s @ d)) * s
        slope, step = gradient @ direction, 1.0
        while True:
            there = at - step * direction
            new, new_gradient = function(there)
            if new <= value - 1e-4 * step * slope or step < 1e-4:
                break
            step /= 2
        if new >= value:
            break
        if (there - at) @ (new_gradient - gradient) > 1e-12:
            moves = [*moves, (there - at, new_gradient - gradient)][-memory:]
        done = value - new < 1e-5 * max(1.0, abs(value))
        at, value, gradient = there, new, new_gradient
        if done:
            break
    return at


def logistic_curve(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and offset of weighted logistic regression, held back a little
    towards slope 1 and the raw odds."""
    weight = weight / weight.mean() if len(weight) else weight
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * raw + offset)))
        g = np.array([((p - y) * weight * raw).sum() + (slope - 1), ((p - y) * weight).sum() + 0.1 * offset])
        v = p * (1 - p) * weight
        h = np.array([[(v * raw * raw).sum() + 1, (v * raw).sum()], [(v * raw).sum(), v.sum() + 0.1]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = max(0.05, slope - move[0]), offset - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(slope), float(offset)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, steps: int = STEPS) -> Model | None:
    """Learn from ``labels(doc_id, quality)`` of rows that are not held out; other
    values than 0 and 1 are no labels, an id with both counts as one row of each.
    None without any labelled row."""
    spark = docs.sparkSession
    on_workers(spark)
    sample = _sample(docs, labels, per_class)
    table = _feature_table(sample.where("not calibrate"))

    def cost(theta):
        value, gradient = _gradient_job(table, theta)
        free = theta.copy()
        free[0] = 0
        return RIDGE * free @ free - value, 2 * RIDGE * free - gradient

    model = Model(minimise(cost, np.zeros(N_PARAMETERS), steps), (1.0, 0.0))

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(0), BLOCK_BYTES):
                lines = lines_of(b)
                raw = model.raw(lines, model.lines(b, lines))
                yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1).slice(b.lo, len(b)), batch.column(2).slice(b.lo, len(b))],
                                                 ["raw", "y", "weight"])

    got = sample.where("calibrate").select("text", "y", "weight").mapInArrow(run, "raw double, y int, weight double").toPandas()
    if table.isEmpty() and got.empty:
        return None
    got = got.sort_values(["raw", "y"])
    model.curve = logistic_curve(got["raw"].to_numpy(), got["y"].to_numpy(float), got["weight"].to_numpy())
    return model


# --- prediction -------------------------------------------------------------------------------

def label_lines(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` as a struct column ``row``, with ``lines``: each line's text and its
    probability of being good.  Null texts are one empty line."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).select(F.struct("*").alias("row"))

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(0).field("text"), BLOCK_BYTES):
                lines = lines_of(b)
                good = shared.value.lines(b, lines)
                texts = [b.data[s:e].tobytes().decode() for s, e in zip(lines.starts, lines.ends)]
                each = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(good)], ["line", "good"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, len(b)), pa.ListArray.from_arrays(pa.array(lines.first.astype(np.int32)), each)], ["row", "lines"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, lines array<struct<line:string,good:double>>")


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` as a struct column ``row``, with ``n_lines``, ``score`` (probability of
    label 1) and ``predicted``.  Without a model the score is 0.5."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.withColumn("text", F.col("text").cast("string")).select(F.struct("*").alias("row"))

    def run(batches):
        m = shared.value
        for batch in batches:
            for b in blocks(batch.column(0).field("text"), BLOCK_BYTES):
                lines = lines_of(b)
                quality = m.quality(m.raw(lines, m.lines(b, lines))) if m is not None else np.full(len(b), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, len(b)), pa.array(np.diff(lines.first)), pa.array(quality),
                     pa.array((quality >= threshold).astype(np.int32))], ["row", "n_lines", "score", "predicted"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, n_lines long, score double, predicted int")


def predict(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``(doc_id, held_out, score,
    predicted, n_lines)``.  Only the text is used to score; null texts are empty ones
    and have one empty line.  Repeated rows give repeated rows, an empty table none;
    rows without an id are scored but not learned from; other columns are ignored."""
    docs = docs.select("doc_id", "text")
    out = score(docs, train(docs, labels, per_class))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted", "n_lines")
