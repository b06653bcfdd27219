"""Spark session defaults for the library and its tests."""

from __future__ import annotations

import os
import tempfile

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Shuffle partitions of ``small_tasks`` before Spark joins neighbours, and the size up to which it does.
PARTS, PART_SIZE = 1_000, "8m"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "salesspark", driver_memory: str | None = None) -> SparkSession:
    """Return (or create) a session with the settings every operator assumes.

    On a cluster the master, memory and shuffle width come from spark-submit;
    locally we default to ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    launched_by_submit = bool(os.environ.get("PYSPARK_GATEWAY_PORT"))  # spark-submit already chose a master
    if master:
        builder = builder.master(master)
    elif not launched_by_submit and not os.environ.get("SPARK_MASTER") \
            and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.master("local[*]")
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if driver_memory:  # only effective when this call starts the JVM (local mode: the only heap)
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the queries that run inside are dealt in many parts, of which Spark joins neighbours up to a small size."""
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with _settings(spark, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.advisoryPartitionSizeInBytes": PART_SIZE}):
        yield


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs inside go when it ends, instead of when the driver happens to collect its garbage."""
    with _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared ``spark.checkpoint.dir`` of the cluster. Only a local master, where every task runs in the
    driver's process, gets a scratch folder if it is unset; on a cluster a local folder would lose data."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="salesspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Make ``salesspark`` importable on the executors' Python workers (needed by the
    pandas functions of the isolation forest), the same way ``--py-files`` would:
    the package's .py files are zipped once per driver and added with ``addPyFile``."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_salesspark_shipped", False):  # kept on the context, so a restarted one ships again
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="salesspark-pyfiles-"), "salesspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(path)
    sc._salesspark_shipped = True
