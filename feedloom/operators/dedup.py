"""Key-based set operators: merge (distinct by key), diff, archive upsert.

None of them sorts: order is carried by ``pos`` and applied once at the sink
(``rank`` / ``sort_published``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import with_key
from .filters import behind_barrier, optimizer_barrier
from .items import union_ordered


def merge_items(df: DataFrame, keep_empty_keys: bool = False) -> DataFrame:
    """Keep the first item (lowest ``pos``) of every dedup key.

    Rows with an empty key collapse to one row, as in the reference; with
    ``keep_empty_keys=True`` every empty-key row is kept.

    Plan: one hash aggregation on the key with ``min_by(row, pos)``; the
    partial aggregate runs before the shuffle, so a hot key sends at most
    one row per map task.
    """
    cols = df.columns
    keyed = with_key(df, "_key")
    if keep_empty_keys:
        keyed = keyed.withColumn("_key", F.when(F.col("_key") == "", F.concat(
            F.lit("\u0000"), F.col("pos").cast("string"))).otherwise(F.col("_key")))
    agg = (keyed
           .groupBy("_key")
           .agg(F.min_by(F.struct(*cols), F.col("pos")).alias("_row")))
    return agg.select("_row.*")


def diff_items(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``.

    Left duplicates are kept; empty right keys are not registered, so an
    empty-key left row always survives.  Left anti join on the key.
    """
    # distinct keys: a partial aggregate before the shuffle collapses a hot
    # key on the right to one row per map task
    rkeys = (optimizer_barrier(with_key(right, "_key").select("_key"))
             .filter(behind_barrier(F.col("_key") != "")).select("_key").distinct())
    lk = with_key(left, "_key")
    return lk.join(rkeys, "_key", "left_anti").drop("_key")


def archive_upsert(new: DataFrame, archived: DataFrame) -> DataFrame:
    """New items, then archived items whose key is absent from the new ones.

    New duplicates are kept; archived duplicates collapse to their first
    occurrence; the empty key counts as a key here.  Output ``pos`` orders
    all new rows before all archived rows.
    """
    nkeys = with_key(new, "_key").select("_key").distinct()
    old = with_key(archived, "_key")
    first_old = (old.groupBy("_key").agg(F.min_by(F.struct(*archived.columns), F.col("pos")).alias("_row")))
    kept_old = first_old.join(nkeys, "_key", "left_anti").select("_row.*")
    return union_ordered(new, kept_old.select(*archived.columns))
