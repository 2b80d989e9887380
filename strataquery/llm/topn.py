"""Top N items within every group, groups of any size included.

Scores fall into a bounded number of ordered buckets. A histogram per group gives the highest bucket
above which at least N items are certain to lie; rows below it cannot be among the first N. Only groups
that own a noticeable share of all rows need that filter (there are at most GROUPS of them, so their
thresholds can be broadcast); Spark limits every group per task before the final exact ranking anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.session import stored

#: Groups with at least 1/GROUPS of all rows get a threshold.
GROUPS = 4096
#: Buckets per doubling of the score.
FINENESS = 8


def score_bucket(score: Column) -> Column:
    """An order-preserving bucket, at most 2 * FINENESS * 1024 different ones; null for null and NaN."""
    size = F.floor(F.log2(F.abs(score).cast("double") + 1) * FINENESS)
    return F.when(score.isNull() | F.isnan(score.cast("double")), None).otherwise(F.when(score < 0, -size - 1).otherwise(size))


def thresholds(rows: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """(group, floor): lowest bucket that can hold one of the first n, for groups with a share of 1/GROUPS."""
    histogram = rows.groupBy(group, score_bucket(F.col(score)).alias("bucket")).agg(F.count("*").alias("items"))
    sizes = histogram.groupBy(group).agg(F.sum("items").alias("size"))
    large = sizes.where(F.col("size") * GROUPS >= sizes.agg(F.sum("size")).scalar()).select(group)
    down = Window.partitionBy(group).orderBy(F.col("bucket").desc_nulls_last())
    reached = histogram.join(F.broadcast(large), group, "left_semi").withColumn("above", F.sum("items").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return reached.where(F.col("above") >= n).groupBy(group).agg(F.max("bucket").alias("__floor"))


def top_n(rows: DataFrame, group: str, score: str, ties: list[Column], n: int) -> DataFrame:
    """The first n rows of each group by score descending, then by ties; `rank` counts from 1.

    Null and NaN scores come last. Rows with a null group belong to no group and are left out. Groups
    with fewer than n rows come out whole. ties should make the order total.
    """
    rows = rows.where(F.col(group).isNotNull())
    floors = F.broadcast(thresholds(rows, group, score, n))  # at most GROUPS rows
    kept = rows.join(floors, group, "left").where(F.col("__floor").isNull() | (score_bucket(F.col(score)) >= F.col("__floor"))).drop("__floor")
    value = F.when(F.isnan(F.col(score).cast("double")), None).otherwise(F.col(score))
    order = Window.partitionBy(group).orderBy(value.desc_nulls_last(), *ties)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def most_complex(definitions: DataFrame, code_stats: DataFrame, n: int = 3) -> DataFrame:
    """(file_id, def_id, cyclomatic, cognitive, rank): the n most complex definitions of each file.

    The latest parse of a definition holds, among equal times the greater metrics; a null metric is 0.
    Definitions without file_id or without metrics are left out; repeated rows count once (should one
    def_id name several files, the smallest holds).
    """
    # The pair of metrics becomes one long, so that both aggregations hash fixed-width values.
    pair = lambda a, b: F.shiftleft(F.coalesce(F.col(a), F.lit(0)).cast("long"), 32) + F.coalesce(F.col(b), F.lit(0)).cast("long") + F.lit(1 << 31)
    seen = code_stats.where("def_id is not null").select(
        "def_id", F.coalesce(F.unix_micros("parsed_at"), F.lit(-(1 << 62))).alias("at"), pair("cyclomatic_complexity", "cognitive_complexity").alias("pair")
    )
    latest = seen.groupBy("def_id").agg(F.max(F.struct("at", "pair")).alias("last"))
    where = definitions.where("file_id is not null and def_id is not null").groupBy("def_id").agg(F.min("file_id").alias("file_id"))
    metric = F.col("last.pair") - F.lit(1 << 31)
    low = F.pmod(F.col("last.pair"), F.lit(1 << 32)) - F.lit(1 << 31)
    rows = where.join(latest, "def_id").select("file_id", "def_id", F.shiftright(metric - low, 32).cast("int").alias("cyclomatic"), low.cast("int").alias("cognitive"))
    return top_n(stored(rows, "complexity"), "file_id", "cyclomatic", [F.col("cognitive").desc(), F.col("def_id").asc()], n)


def p3_found(spark, folder):
    from strataquery.sources.tables import table

    definitions = table(spark, folder, "definitions", "def_id", "file_id")
    stats = table(spark, folder, "code_stats", "def_id", "cyclomatic_complexity", "cognitive_complexity", "parsed_at")
    return most_complex(definitions, stats, 3).select("file_id", "def_id")
