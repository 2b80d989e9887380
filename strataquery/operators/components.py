"""Connected components by alternating large and small stars, in O(log^2) rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.plans.skew import salted_join
from strataquery.session import forget, stored


def _to_least(edges: DataFrame, keep: str) -> DataFrame:
    """Edges (u, v) of each u moved to the least of u and its neighbours; hubs are split over tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    joined = salted_join(edges, least.select("u", "m"), ["u"], least.select("u", "n"), "n", F.xxhash64("v"))
    if keep == "larger":  # large star: only neighbours above u move
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every id of edges (a long, b long) with the least id it is connected to.

    Self-loops and nulls are left out; ids without an edge do not come out. Stops when a round changes nothing.
    """
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == before:
            return state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(state.select("v", "v").distinct())
        before = tuple(mark)
        large = _to_least(state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v"))), "larger").distinct()
        small = _to_least(large.where("u <> v"), "all")
        old, state = state, stored(small.where("u <> v").distinct(), "edges")
        forget(old)
