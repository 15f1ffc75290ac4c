"""Ordered text documents built from rows.

A document is a DataFrame of ``(k1, k2, k3, line)`` rows whose order is
given by the keys; writing it is one distributed sort plus a text write
(no row group is ever collected).  ``collect_document`` assembles the text
on the driver and is meant for small outputs and tests only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["k1", "k2", "k3"]


def lines(df: DataFrame, line, k1=0, k2=0, k3=0) -> DataFrame:
    def key(v, name):
        c = F.lit(v) if not hasattr(v, "alias") else v
        wide = isinstance(df.select(c.alias("k")).schema[0].dataType, T.DecimalType)  # an order over several sources
        return (c if wide else c.cast("long")).alias(name)
    return df.select(key(k1, "k1"), key(k2, "k2"), key(k3, "k3"),
                     (F.lit(line) if isinstance(line, str) else line).alias("line"))


def header(spark, *texts: str, k1: int = 0) -> DataFrame:
    return spark.createDataFrame([(k1, i, 0, t) for i, t in enumerate(texts)], "k1 long, k2 long, k3 long, line string")


def write_document(doc: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the lines in key order as text part files (one line per row)."""
    doc.orderBy(*KEYS).select("line").write.mode(mode).text(path)


def collect_document(doc: DataFrame, sep: str = "\n") -> str:
    """Small outputs only: the document text assembled on the driver."""
    return sep.join(r.line for r in doc.orderBy(*KEYS).select("line").collect())
