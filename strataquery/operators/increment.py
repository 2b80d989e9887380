"""Processing only new or changed records, by a Merkle tree over ranges of key hashes.

A store keeps, per committed version, the changed records (the output), and the tree of digests over the
records that version was given. The next run hashes its own records into the same ranges and goes down from
the top, only where digests differ: what lies below an equal digest was there, unchanged, the run before, and
is neither compared nor read. Saved records are read for the differing leaves only; keys a run does not see
keep their state, and make no leaf differ again once they have been away for one run. Leaves are as small as
the share of changed records asks for, and the tree grows with the records. Output and tree are written
first; one rename of a manifest publishes both. A run that dies before leaves nothing visible and is simply
run again.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.plans.skew import maybe_broadcast
from strataquery.session import remove, scratch

#: Children of a node are 2**FAN. The top level, of at most 2**TOP nodes, is compared on the driver and kept in the manifest.
FAN, TOP = 6, 12
#: Records of a leaf while the share of changes is unknown; share of leaves that may differ; bits of the finest tree.
LEAF_ROWS, DIFFERING, MOST_BITS = 64, 0.25, 44
#: Versions whose records are read side by side before they are folded into one.
FOLD_AFTER = 16
#: Ranges of hashes that are pushed down to a scan.
RANGES = 64
CHANGES = "h long, key string, digest string, version int, run long"
TREE = "level int, node long, d1 long, d2 long"


def clean_path(path: Column) -> Column:
    """`/` between parts, none doubled, no leading `./`."""
    slashes = F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")
    return F.regexp_replace(slashes, r"^(\./)+", "")


class IncrementalStore:
    """Versions of a keyed state (key string, digest string) in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def manifest(self) -> dict | None:
        """The latest published version, or None."""
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{max(numbers):09d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """One rename makes a version visible; a version that is already there is never replaced."""
        temporary = self._path(f"{self.folder}/staged-{manifest['version']}-{uuid.uuid4().hex}.json")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
        if not self._fs.rename(temporary, self._path(f"{self.folder}/manifests/{manifest['version']:09d}.json")):
            raise RuntimeError(f"version {manifest['version']} was published by another run")

    def _leaves(self, rows: DataFrame, bits: int) -> DataFrame:
        """(node, d1, d2, n) of the leaves at a depth; digests do not depend on the order of records."""
        hashes = F.bit_xor(F.xxhash64("key", "digest")).alias("d1"), F.bit_xor(F.xxhash64("digest", F.lit(0), "key")).alias("d2")
        return rows.groupBy(_node(bits).alias("node")).agg(*hashes, F.count("*").alias("n"))

    def _tree(self, rows: DataFrame, bits: int, path: str) -> tuple[dict[int, list[int]], str | None]:
        """(top level by node, where the levels below it are written, None if the leaves are the top)."""
        nodes, written = self._leaves(rows, bits), None
        if bits > TOP:
            nodes.select(F.lit(bits).alias("level"), "node", "d1", "d2", "n").write.partitionBy("level").parquet(path)
            written, level = path, bits
            nodes = self.spark.read.schema("node long, d1 long, d2 long, n long").parquet(f"{path}/level={bits}")
            while level > TOP:
                level -= FAN
                merged = F.bit_xor(F.xxhash64("node", "d1")).alias("d1"), F.bit_xor(F.xxhash64("d2", "node")).alias("d2")
                nodes = nodes.groupBy(F.shiftright("node", FAN).alias("node")).agg(*merged, F.sum("n").alias("n"))
                if level > TOP:
                    nodes.write.parquet(f"{path}/level={level}")
                    nodes = self.spark.read.schema("node long, d1 long, d2 long, n long").parquet(f"{path}/level={level}")
        return {r.node: [r.d1, r.d2, r.n] for r in nodes.collect()}, written  # at most 2**TOP rows

    def _differing(self, path: str, saved: str, nodes: list[int], bits: int) -> DataFrame:
        """(node) of the leaves that differ, reached from the top's nodes through differing nodes only."""
        levels = list(range(bits, TOP, -FAN))[::-1]
        at, shift = None, F.shiftright("node", FAN)
        for level in levels:
            new, old = (self.spark.read.schema("node long, d1 long, d2 long").parquet(f"{p}/level={level}") for p in (path, saved))
            if level == levels[0]:
                new, old = (x.where(f"shiftright(node, {FAN}) IN ({', '.join(map(str, nodes))})") for x in (new, old))
            else:
                new = new.join(at.select(F.col("node").alias("above")), shift == F.col("above"), "left_semi")
            at = new.join(old, ["node", "d1", "d2"], "left_anti").select("node")
        return at

    def _records(self, parts: list[str]) -> DataFrame:
        """All records of published versions; later versions win."""
        return self.spark.read.schema(CHANGES).parquet(*[f"{self.folder}/{d}/changes" for d in parts])

    def process(self, run: int, records: DataFrame) -> DataFrame:
        """Publishes what is new or changed in records (key, digest; one row per key) since the last version.

        Null keys and null digests tell nothing. Keys that are not among the records keep their state.
        Returns (run, key, digest) of the changes. Processing a published run again returns what it published.
        """
        saved = self.manifest()
        if saved and str(run) in saved["runs"]:
            return self.output(run)
        version = saved["version"] + 1 if saved else 0
        rows = records.where("key is not null and digest is not null").select(F.xxhash64("key").alias("h"), "key", "digest")
        folder = scratch(self.spark, "v").rsplit("/", 1)[1]
        path = f"{self.folder}/{folder}"
        bits = saved["bits"] if saved else _depth(rows.count(), LEAF_ROWS)
        top, written = self._tree(rows, bits, f"{path}/tree")
        n = sum(x[2] for x in top.values())
        leaves = descended = 0
        if saved:
            old = {int(k): v for k, v in saved["top"].items()}
            nodes = sorted(k for k, v in top.items() if old.get(k) != v)
            changed = None  # leaves as a frame, where they lie below the top
            if written and nodes and saved["tree"]:
                self._differing(written, f"{self.folder}/{saved['tree']}", nodes, bits).write.parquet(f"{path}/differing")
                changed = self.spark.read.schema("node long").parquet(f"{path}/differing")
            leaves = self.spark.read.parquet(f"{written}/level={bits}").count() if written else len(top)
            descended = changed.count() if changed is not None else len(nodes) if not written else leaves if nodes else 0
            changes = self._changes(saved, rows, bits, nodes, len(top), changed)
        else:
            changes = rows.repartitionByRange("h").sortWithinPartitions("h")
        changes.select("h", "key", "digest", F.lit(version).alias("version"), F.lit(run).cast("long").alias("run")).write.parquet(f"{path}/changes")
        parts = [*(saved["parts"] if saved else []), folder]
        if len(parts) > FOLD_AFTER:
            parts = [self._fold(parts)]
        manifest = {"version": version, "runs": {**(saved["runs"] if saved else {}), str(run): folder}, "parts": parts, "leaves": leaves, "descended": descended}
        if n or not saved:
            rate = _rate(leaves, descended, n) if saved and leaves else saved["rate"] if saved else None
            wanted = _depth(n, _leaf_rows(rate))
            if abs(wanted - bits) >= 2:  # outgrown, or the changes are more or fewer than the leaves are made for
                bits = wanted
                top, written = self._tree(rows, bits, f"{path}/tree-{bits}")
            kept = {"bits": bits, "top": top, "tree": written.removeprefix(f"{self.folder}/") if written else None, "rate": rate}
        else:  # a run without records says nothing of the others
            kept = {k: saved[k] for k in ("bits", "top", "tree", "rate")}
        self._publish(manifest | kept)
        return self.output(run)

    def _changes(self, saved: dict, rows: DataFrame, bits: int, nodes: list[int], all_nodes: int, changed: DataFrame | None) -> DataFrame:
        """Records of the differing leaves that are new or differ from the saved state."""
        before = self._records(saved["parts"])
        if not nodes:
            return rows.where("false")
        if len(nodes) < all_nodes or changed is not None:
            top = min(bits, TOP) if bits <= TOP else bits - FAN * math.ceil((bits - TOP) / FAN)
            inside = _ranges(nodes, top)
            rows, before = rows.where(inside), before.where(inside)
            if changed is not None:
                leaves = maybe_broadcast(changed)
                rows, before = (x.withColumn("node", _node(bits)).join(leaves, "node", "left_semi") for x in (rows, before))
            else:
                picked = f"IN ({', '.join(map(str, nodes))})"
                rows, before = (x.withColumn("node", _node(bits)).where(f"node {picked}") for x in (rows, before))
        last = before.groupBy("key").agg(F.max(F.struct("version", "digest")).alias("last")).select("key", F.col("last.digest").alias("was"))
        return rows.join(last, "key", "left").where(~F.col("digest").eqNullSafe(F.col("was")))

    def _fold(self, parts: list[str]) -> str:
        folder = scratch(self.spark, "fold").rsplit("/", 1)[1]
        rows = self._records(parts).groupBy("h", "key").agg(F.max(F.struct("version", "digest", "run")).alias("last"))
        rows.select("h", "key", "last.digest", "last.version", "last.run").repartitionByRange("h").sortWithinPartitions("h").write.parquet(f"{self.folder}/{folder}/changes")
        return folder

    def output(self, *runs: int) -> DataFrame:
        """(run, key, digest) published by the given runs, or by all; one scan over their folders."""
        manifest = self.manifest()
        published = manifest["runs"] if manifest else {}
        folders = [published[str(r)] for r in runs] if runs else list(published.values())
        if not folders:
            return self.spark.createDataFrame([], "run long, key string, digest string")
        return self._records(folders).select("run", "key", "digest")


def _node(bits: int) -> Column:
    """The leaf of a key's hash at a depth."""
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")


def _depth(rows: int, leaf_rows: float) -> int:
    """Bits of a tree whose leaves hold about leaf_rows records."""
    return min(max(math.ceil(math.log2(max(rows, 1) / leaf_rows)), 0), MOST_BITS)


def _rate(leaves: int, descended: int, rows: int) -> float:
    """Share of records that changed, seen from the share of leaves that differ."""
    equal = max(1 - descended / leaves, 0.5 / leaves)
    return 1 - equal ** (leaves / max(rows, leaves))


def _leaf_rows(rate: float | None) -> float:
    """Records of a leaf so that about DIFFERING of the leaves differ at a share of changed records."""
    if rate is None:
        return LEAF_ROWS
    return min(max(math.log(1 - DIFFERING) / math.log(1 - min(max(rate, 1e-6), 0.999)), 1.0), 4096.0)


def _ranges(nodes: list[int], bits: int) -> Column:
    """A condition on h that holds for all keys below the given nodes, in at most RANGES ranges, for scans to skip row groups by."""
    while True:
        runs: list[list[int]] = []
        for node in sorted(set(nodes)):
            if runs and runs[-1][1] == node - 1 and (bits == 0 or node != 1 << (bits - 1)):  # hashes are signed
                runs[-1][1] = node
            else:
                runs.append([node, node])
        if len(runs) <= RANGES:
            break
        nodes, bits = [n >> 1 for n in nodes], bits - 1
    if not bits:
        return F.lit(True)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    size = 64 - bits
    return F.expr(" OR ".join(f"h BETWEEN {signed(a << size)} AND {signed(((b + 1) << size) - 1)}" for a, b in runs).replace(str(-(1 << 63)), f"(-{(1 << 63) - 1} - 1)"))


def run_states(fingerprints: DataFrame, runs: list[int]) -> DataFrame:
    """(run_id, key, digest): per run and cleaned path the hash with the latest seen_at, ties by obs_id.

    Rows without path, run or hash are left out; hashes are compared in lower case.
    """
    rows = fingerprints.where(F.col("run_id").isin(runs) & F.col("content_hash").isNotNull() & F.col("path").isNotNull()).select(
        "run_id", clean_path(F.col("path")).alias("key"), F.struct("seen_at", "obs_id", F.lower("content_hash").alias("digest")).alias("seen")
    )
    return rows.groupBy("run_id", "key").agg(F.max("seen").alias("seen")).select("run_id", "key", F.col("seen.digest").alias("digest"))


def changed_inputs(fingerprints: DataFrame, index_runs: DataFrame, folder: str | None = None, first: int | None = None) -> DataFrame:
    """(run_id, path) new or changed in each successful run since the successful runs before it.

    The loop goes over runs, of which there are few; records never leave the executors. Runs that did
    not succeed are not looked at, so nothing they saw is lost or repeated. Without runs: no rows. A folder
    of an earlier call is gone on with: its runs are not processed again. first: stop after so many runs.
    """
    spark = fingerprints.sparkSession
    store = IncrementalStore(spark, folder or scratch(spark, "increment"))
    ok = sorted({r.run_id for r in index_runs.where("status = 'ok' and run_id is not null").select("run_id").distinct().collect()})[:first]
    done = (store.manifest() or {"runs": {}})["runs"]
    fresh = [r for r in ok if str(r) not in done]
    if fresh:
        states = f"{store.folder}/states-{uuid.uuid4().hex}"
        run_states(fingerprints, fresh).write.partitionBy("run_id").parquet(states)
        records = spark.read.schema("key string, digest string")
        for run in fresh:
            seen = store.exists(f"{states}/run_id={run}")
            store.process(run, records.parquet(f"{states}/run_id={run}") if seen else spark.createDataFrame([], "key string, digest string"))
        remove(spark, states)
    return (store.output(*ok) if ok else store.output()).select(F.col("run").alias("run_id"), F.col("key").alias("path"))
