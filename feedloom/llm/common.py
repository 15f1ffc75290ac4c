"""Helpers shared by the operators: text blocks, word hashes and shared tables.

Python tasks see documents as Arrow batches.  ``blocks`` cuts a batch into runs
of whole documents of about ``BLOCK_BYTES`` so that the numpy temporaries of one
step stay in cache and memory does not depend on the batch size (one very long
document makes a block of its own)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from feedloom.session import checkpoint_dir, ship_package

BLOCK_BYTES = 1 << 18


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder (``spark.checkpoint.dir``) and read it
    back: cuts the lineage, and lost executors cost a re-read only."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """A folder of intermediate tables in the shared folder, deleted on leaving
    the ``with`` block: what is needed later is to be saved elsewhere before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


ROWS_PER_BATCH = "2000"


def on_workers(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and keep the batches
    they get small: rows are whole texts here (a size set by the user stays)."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


@dataclass
class Block:
    """Whole documents ``lo..hi`` of a batch: UTF-8 bytes and their offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Null texts count as empty ones."""
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(arr)
    if not n:
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + n + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        lo = hi


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Words:
    """Words of a block: byte ``starts`` and ``ends``; document ``d`` has words
    ``first[d]..first[d + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def words_of(block: Block, separators: np.ndarray = SPACES) -> Words:
    """Maximal runs of bytes that are no separators, within each document."""
    inside = np.zeros(len(block.data) + 2, bool)
    inside[1:-1] = ~separators[block.data]
    cuts = block.offsets[1:-1]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    cuts = cuts[(cuts > 0) & (cuts < len(block.data))]
    opens[cuts] |= inside[1:-1][cuts]
    closes[cuts - 1] |= inside[1:-1][cuts - 1]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, block.offsets))


# --- polynomial hashes modulo 2**64 -------------------------------------------------

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the seed's base and of its inverse."""
    have = _tables.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 18)
        base = _BASES[seed]
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                         for b in (base, pow(base, -1, 1 << 64)))
        _tables[seed] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all bits (splitmix64's finish)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``values[s:e]`` for each range; equal contents give equal hashes."""
    up, down = powers(len(values) + 1, seed)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(word_hashes: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``k`` consecutive words, by starting word; and which of
    them lie within one document."""
    n = max(0, len(word_hashes) - k + 1)
    whole = np.ones(n, bool)
    for cut in range(1, k):
        at = first[1:-1] - cut
        whole[at[(at >= 0) & (at < n)]] = False
    starts = np.arange(n)
    return range_hashes(word_hashes, starts, starts + k, seed), whole


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over ``width`` consecutive values, by first value."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        gap = width - have
        out = np.minimum(out[:len(out) - gap], out[gap:])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
