"""Retrieval quality over runs (query_id, rank, path) and judgments (query_id, path, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quality(runs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Per judged query: ndcg_at_10, mrr_at_10 (grade 2 or better), recall_at_50, success_at_1 (grade 3), negatives_at_10 (grade 0).

    Queries without results score 0; unjudged results count as grade 0 but not as negatives.
    """
    graded = judgments.join(runs, ["query_id", "path"], "left")
    gain = lambda grade, place: (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1)
    ideal_place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "path"))
    ideal = judgments.where("grade > 0").withColumn("place", ideal_place).where("place <= 10").groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("ideal"))
    got = graded.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= 10, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.coalesce(1 / F.min(F.when((F.col("rank") <= 10) & (F.col("grade") >= 2), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when((F.col("rank") <= 50) & (F.col("grade") > 0), 1.0)) / F.sum(F.when(F.col("grade") > 0, 1.0)), F.lit(0.0)).alias("recall"),
        F.max(F.when((F.col("rank") == 1) & (F.col("grade") == 3), 1).otherwise(0)).alias("success_at_1"),
        F.sum(F.when((F.col("rank") <= 10) & (F.col("grade") == 0), 1).otherwise(0)).alias("negatives_at_10"),
    )
    rounded = lambda c: F.round(c, 6)
    return got.join(ideal, "query_id", "left").select(
        "query_id",
        rounded(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0))).alias("ndcg_at_10"),
        rounded(F.col("mrr")).alias("mrr_at_10"),
        rounded(F.col("recall")).alias("recall_at_50"),
        "success_at_1",
        "negatives_at_10",
    )


def mean_quality(per_query: DataFrame) -> DataFrame:
    """One row of means over queries, rounded to 6 places."""
    metrics = ("ndcg_at_10", "mrr_at_10", "recall_at_50", "success_at_1")
    return per_query.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(m), 6).alias(m) for m in metrics], F.sum("negatives_at_10").alias("negatives_at_10"))
