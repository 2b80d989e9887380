"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Set only where the session leaves them unset, so that a cluster's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("strataquery")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees.

    Only where the session names none and runs on one machine, a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="strataquery-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return _checkpoint_dir(spark)


def _checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.sparkContext.getCheckpointDir()


#: Paths made within each open scope, innermost last.
_SCOPES: list[list[str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; within a scope it is removed with it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared folder, if they are there."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was stored within: read or write a query's result before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        remove(spark, *_SCOPES.pop())


@contextmanager
def lasting() -> Iterator[None]:
    """What is stored within outlives the scopes around it."""
    _SCOPES.append([])
    try:
        yield
    finally:
        _SCOPES.pop()


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, as the states of a loop that has gone on."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            remove(df.sparkSession, path)
