"""Session helpers: one place for the settings every operator relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings the operators assume.  UTC keeps wall-clock timestamps stable
# between Spark, the JSON/RSS sinks and the SQL oracle.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
}
# Settings that only tune performance; applied when the user left them unset.
_TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keyed streaming state (per-entry comment state) off the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "feedloom",
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session with the settings the library expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    for k, v in {**_TUNING, **_REQUIRED}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in extra.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply required runtime settings to an existing session."""
    for k, v in _REQUIRED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    for k, v in _TUNING.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring Spark to use it.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    file system path).  Only when nothing is configured and the master is
    local -- tests -- a private temporary folder is created; on a cluster a
    missing setting is an error, as executors do not share such a folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local($|\[)", sc.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="feedloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Make ``feedloom`` importable in the Python workers (once per context).

    Operators that run Python on executors (external commands, the
    streaming per-key state, the exact entity decoder) pickle functions of
    this package by reference; the workers import it from a zip that Spark
    distributes with ``addPyFile``."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_feedloom_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="feedloom-pyfiles-")
    zpath = os.path.join(out, "feedloom.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    sc._feedloom_shipped = True


# Bounds of the Arrow batches in which whole pages go to Python workers.
PAGE_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
                "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def send_pages(spark: SparkSession) -> None:
    """Ready the session for UDFs over whole pages: the package on the workers, and
    batches bounded in rows and bytes, so that a worker's memory does not grow with
    the table (a size set by the user stays)."""
    ship_package(spark)
    for k, v in PAGE_BATCHES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
