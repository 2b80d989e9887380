"""Keeping the content index current from a stream of change events, and windows over event streams."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.operators.index import postings
from strataquery.session import scratch, stored
from strataquery.sources.store import read_json, write_json

POSTINGS = "token string, file_id long, lines array<int>, tf long"
#: Deltas that are read beside the base; a base is written anew beyond that, or when all rows are more than GROWN times its own (fixed value of the latter).
FOLD_AFTER, GROWN = 16, 3
#: Events that are no changes of indexed files.
INTERNAL = r"(^|/)\.git(/|$)"


def last_states(events: DataFrame) -> DataFrame:
    """One row per path of a batch (path, op, ts, text): the last event wins; internal paths are left out."""
    kept = events.where(~F.rlike("path", F.lit(INTERNAL)))
    return kept.groupBy("path").agg(F.max_by(F.struct("op", "text"), F.struct("ts", "op")).alias("last")).select("path", "last.op", "last.text")


class StreamedIndex:
    """Versions of postings (token, file_id, lines, tf) in one folder; version n holds batches 0 to n.

    A batch writes a delta: the postings of its files, and which files it speaks for. Reading lays the deltas
    over the base: of a file the latest version that speaks for it holds. What a batch writes is as large as
    its own files, whatever the size of the index; folding makes a new base. A manifest per version names
    base and deltas and is put in place last. A batch that is run again after a failure starts from the
    version before it, so nothing is applied twice; an index that is opened again goes on at its latest one.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or scratch(spark, "streamed")
        self.version = max(self._versions(), default=-1)

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit()]

    def _manifest(self, version: int) -> dict:
        """The latest manifest up to a version."""
        known = [v for v in self._versions() if v <= version]
        return read_json(self.spark, f"{self.folder}/manifest-{max(known)}.json") if known else {"base": None, "deltas": [], "base_rows": 0, "rows": 0}

    def _part(self, label: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{label}")

    def _read(self, manifest: dict) -> DataFrame:
        parts = [self._part(manifest["base"], POSTINGS).withColumn("__v", F.lit(-1))] if manifest["base"] else []
        spoken = None
        for d in manifest["deltas"]:
            parts.append(self._part(f"{d}/postings", POSTINGS).withColumn("__v", F.lit(int(d[1:].split("-")[0]))))
            own = self._part(f"{d}/files", "file_id long").withColumn("__v", F.lit(int(d[1:].split("-")[0])))
            spoken = own if spoken is None else spoken.union(own)
        if not parts:
            return self.spark.createDataFrame([], POSTINGS)
        rows = functools.reduce(DataFrame.union, parts)
        if spoken is not None:
            last = spoken.groupBy("file_id").agg(F.max("__v").alias("__last"))
            rows = rows.join(last, "file_id", "left").where("__last is null or __last = __v")
        return rows.select("token", "file_id", "lines", "tf")

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._manifest(self.version if version is None else version))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Applies one batch of events; file_id is the path's hash. Changed files without text keep their entries."""
        before = self._manifest(batch_id - 1)
        delta = f"v{batch_id}-{uuid.uuid4().hex[:8]}"
        states = stored(last_states(batch).withColumn("file_id", F.xxhash64("path")), "states")
        states.where("op = 'remove' or text is not null").select("file_id").write.parquet(f"{self.folder}/{delta}/files")
        postings(states.where("op <> 'remove' and text is not null")).select("token", "file_id", "lines", "tf").write.parquet(f"{self.folder}/{delta}/postings")
        new = self._part(f"{delta}/postings", POSTINGS).count()
        after = {**before, "deltas": [*before["deltas"], delta], "rows": before["rows"] + new}
        if len(after["deltas"]) > FOLD_AFTER or (after["base_rows"] and after["rows"] > GROWN * after["base_rows"]):
            after = self._folded(after, batch_id)
        write_json(self.spark, f"{self.folder}/manifest-{batch_id}.json", after)
        self.version = batch_id

    def _folded(self, manifest: dict, version: int) -> dict:
        base = f"base-{version}-{uuid.uuid4().hex[:8]}"
        self._read(manifest).repartitionByRange("token").sortWithinPartitions("token", "file_id").write.parquet(f"{self.folder}/{base}")
        rows = self._part(base, POSTINGS).count()
        return {"base": base, "deltas": [], "base_rows": rows, "rows": rows}

    def run(self, events: DataFrame) -> DataFrame:
        """Applies all events there are now and returns the index."""
        query = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.read()


def _collected(windowed: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Runs a stream over what there is and returns the last state of every key."""
    spark = windowed.sparkSession
    folder = scratch(spark, "windows")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/b{batch_id}")

    windowed.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, *[F.col(f"last.{v}").alias(v) for v in values])


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type of a stream (ts, event_type, value); later than `late` is dropped with its state."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
    return _collected(per.select(F.col("window.start").alias("start"), "event_type", "n_events", "total"), "update", ["start", "event_type"])


def sessions(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """Bursts of events per key of a stream (ts, key): a pause longer than gap ends a burst."""
    per = events.groupBy(F.session_window("ts", gap), "key").agg(F.count("*").alias("n_events"))
    return _collected(per.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "key", "n_events"), "complete", ["start", "key"])


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over Parquet files of a folder, or over one file."""
    name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).parquet(f"{name[0]}/{name[1][:-1]}[{name[1][-1]}]")


def save_points(changes: DataFrame, quiet: str = "5 minutes", longest: str = "10 minutes") -> DataFrame:
    """(key, save_ts, n_changes): when changes (key, ts) are saved.

    A busy stretch ends with the last change before `quiet` passes without one, and is saved then; one that
    goes on is saved every `longest` from its start on, if there were changes.
    """
    w = Window.partitionBy("key").orderBy("ts")
    fresh = F.coalesce((F.col("ts") >= F.lag("ts").over(w) + F.expr(f"INTERVAL {quiet}")).cast("int"), F.lit(1))
    stretch = changes.where("key is not null and ts is not null").withColumn("__new", fresh).withColumn("__stretch", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    begun = stretch.withColumn("__from", F.min("ts").over(Window.partitionBy("key", "__stretch"))).withColumn("__to", F.max("ts").over(Window.partitionBy("key", "__stretch")))
    length = F.lit(_micros(longest))
    turn = F.floor((F.unix_micros("ts") - F.unix_micros("__from")) / length)
    due = F.timestamp_micros(F.unix_micros("__from") + (F.col("__turn") + 1) * length)
    return (
        begun.withColumn("__turn", turn)
        .groupBy("key", "__from", "__to", "__turn")
        .agg(F.count("*").alias("n_changes"))
        .select("key", F.least(due, F.col("__to") + F.expr(f"INTERVAL {quiet}")).alias("save_ts"), "n_changes")
    )


def _micros(duration: str) -> int:
    number, unit = duration.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")] * 1_000_000
