"""Comparing two snapshots of inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): added, removed or modified keys of two snapshots; one full join, unchanged keys are left out."""
    joined = before.select(key, F.col(value).alias("__old")).join(now.select(key, F.col(value).alias("__new")), key, "full")
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "modified")
    return joined.select(key, status.alias("status")).where("status is not null")


def apply_delta(index: DataFrame, changed: DataFrame, entries: DataFrame, key: str = "file_id") -> DataFrame:
    """The index without the entries of changed keys, with the new entries of these.

    changed has (key, op, readable); entries of inputs that could not be read stay as they were.
    """
    gone = changed.where("op = 'remove' or readable").select(key)
    return index.join(gone, key, "left_anti").unionByName(entries)


#: Seconds by which a file may be older than the snapshot and still count as changed since (fixed value).
SLACK = 2


def drift_by_time(before: DataFrame, now: DataFrame, created: Column, key: str = "path") -> DataFrame:
    """(key, status) against a snapshot of names (key) made at `created`; now has (key, modified).

    Without hashes a file counts as modified if its time is later than the snapshot's less SLACK seconds.
    """
    joined = before.select(key, F.lit(True).alias("__was")).distinct().join(now.select(key, "modified"), key, "full")
    late = F.unix_micros("modified") > F.unix_micros(created) - SLACK * 1_000_000
    status = F.when(F.col("__was").isNull(), "added").when(F.col("modified").isNull(), "removed").when(late, "modified")
    return joined.select(key, status.alias("status")).where("status is not null")


def checked_delta(parsed: DataFrame, current: DataFrame, attempts: int = 3) -> DataFrame:
    """(path, verdict): what becomes of parsed results (path, digest, attempt), which hold for the input of that digest only.

    current has (path, digest) as the inputs are now. Equal digests are applied; an input that changed
    meanwhile is parsed again, up to `attempts` times, then given up, so its old entries stay; one that is
    gone is removed.
    """
    met = parsed.join(current.select("path", F.col("digest").alias("__now"), F.lit(True).alias("__there")), "path", "left")
    verdict = F.when(F.col("__there").isNull(), "remove").when(F.col("digest").eqNullSafe(F.col("__now")), "apply").when(F.col("attempt") < attempts, "again").otherwise("keep old")
    return met.select("path", verdict.alias("verdict"))
