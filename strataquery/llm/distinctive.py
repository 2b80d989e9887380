"""How distinctive a term is per record.

Occurrence counts of a term over all records are seen as a mixture of two Poisson laws: one for records
that merely mention it, one for the elite about it. The mixture is fitted per term by expectation
maximisation on the term's frequency histogram (which is small: a term with T occurrences has at most
sqrt(2 T) different counts), vectorised over many terms. The posterior probability of the elite scores
each count. The histogram also gives the number of records with the term, from which tf-idf follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquery.plans.skew import salted_join
from strataquery.session import stored

ROUNDS = 40
FITTED = "token string, df long, n_files long, elite_share double, elite_rate double, base_rate double"


def fit_two_poisson(term: np.ndarray, count: np.ndarray, records: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elite share, elite rate, base rate) per term from its histogram.

    term numbers the terms from 0 without gaps; count and records are the histogram's rows, n the number
    of all records per term. Records without the term count as zero occurrences.
    """
    terms = len(n)
    df = np.bincount(term, records, terms)
    total = np.bincount(term, records * count, terms)
    zero = np.maximum(n - df, 0.0)
    mean = total / n
    elite = np.maximum(total / np.maximum(df, 1), mean * 1.5) + 0.5
    base = np.maximum(mean * 0.5, 1e-9)
    share = np.clip(df / (2 * n), 1e-9, 0.5)
    for _ in range(rounds):
        odds = np.log(share) - np.log1p(-share)
        weight = 1 / (1 + np.exp(-np.clip((odds - elite + base)[term] + count * np.log(elite / base)[term], -700, 700)))
        weight0 = 1 / (1 + np.exp(-np.clip(odds - elite + base, -700, 700)))
        w = np.bincount(term, records * weight, terms)
        x = np.bincount(term, records * weight * count, terms)
        all_elite = w + zero * weight0
        elite = np.maximum(x / np.maximum(all_elite, 1e-12), 1e-9)
        base = np.maximum((total - x) / np.maximum(n - all_elite, 1e-12), 1e-9)
        share = np.clip(all_elite / n, 1e-12, 1 - 1e-12)
    swap = elite < base
    elite, base = np.where(swap, base, elite), np.where(swap, elite, base)
    return np.where(swap, 1 - share, share), elite, base


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if not len(rows):
            continue
        lens = rows["counts"].map(len).to_numpy()
        term = np.repeat(np.arange(len(rows)), lens)
        counts = np.concatenate(rows["counts"].to_list()).astype(float)
        records = np.concatenate(rows["records"].to_list()).astype(float)
        share, elite, base = fit_two_poisson(term, counts, records, rows["n_files"].to_numpy(float))
        df = np.bincount(term, records, len(rows)).astype(np.int64)
        yield pd.DataFrame({"token": rows["token"], "df": df, "n_files": rows["n_files"], "elite_share": share, "elite_rate": elite, "base_rate": base})


def counted(postings: DataFrame) -> DataFrame:
    """(file_id, token, tf): lower-cased token; rows with equal token, file and lines count once.

    tf adds up the entries of lines. Rows without token, file or any line are no postings.
    """
    rows = postings.where("file_id is not null and token is not null and size(lines) > 0").select("file_id", F.lower("token").alias("token"), "lines")
    return (
        rows.repartition("file_id", "token")  # both aggregations use this one shuffle
        .dropDuplicates(["file_id", "token", "lines"])
        .groupBy("file_id", "token")
        .agg(F.sum(F.size("lines")).cast("long").alias("tf"))
    )


def distinctive_terms(postings: DataFrame, file_stats: DataFrame) -> DataFrame:
    """(file_id, token, tf, n, df, tf_idf, elite): every token of every file of file_stats with its scores.

    tf_idf = round(tf / n * ln(N / df), 9) with n all tf of the file, N the files with postings and df
    those with the token; elite is the posterior probability that the file is about the token. Files
    missing from file_stats count nowhere. Empty inputs give no rows.
    """
    counts = stored(counted(postings), "counts")
    per_file = counts.groupBy("file_id").agg(F.sum("tf").alias("n"), F.count("*").alias("terms"))
    files = stored(per_file.join(file_stats.where("file_id is not null").select("file_id").distinct(), "file_id", "left_semi"), "files")
    rows = stored(salted_join(counts, files.select("file_id", "n"), ["file_id"], files, "terms", F.xxhash64("token")), "rows")
    histogram = rows.groupBy("token", "tf").agg(F.count("*").alias("records")).groupBy("token")
    fitted = histogram.agg(F.collect_list("tf").alias("counts"), F.collect_list("records").alias("records")).withColumn("n_files", files.agg(F.count("*")).scalar())
    terms = stored(fitted.mapInPandas(_fit, FITTED), "terms")
    scored = salted_join(rows, terms, ["token"], terms, "df", F.xxhash64("file_id"))
    odds = F.ln(F.col("elite_share")) - F.ln(1 - F.col("elite_share")) - F.col("elite_rate") + F.col("base_rate") + F.col("tf") * F.ln(F.col("elite_rate") / F.col("base_rate"))
    return scored.select(
        "file_id",
        "token",
        "tf",
        "n",
        "df",
        F.round(F.col("tf") / F.col("n") * F.ln(F.col("n_files") / F.col("df")), 9).alias("tf_idf"),
        (1 / (1 + F.exp(-odds))).alias("elite"),
    )


def telling(scored: DataFrame, top: int = 5, least_files: int = 2) -> DataFrame:
    """The `top` highest tf_idf of each file among tokens in at least least_files files; ties by code points."""
    order = Window.partitionBy("file_id").orderBy(F.col("tf_idf").desc(), F.col("token").asc())
    return scored.where(F.col("df") >= least_files).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _inputs(spark, folder):
    from strataquery.sources.tables import table

    return table(spark, folder, "postings", "token", "file_id", "lines"), table(spark, folder, "file_stats", "file_id")


def p1_found(spark, folder):
    return telling(distinctive_terms(*_inputs(spark, folder))).select("file_id", "token")


def p1_elite(spark, folder):
    """Per file its tokens of the elite: occurrences, terms matched and the summed tf_idf."""
    scored = distinctive_terms(*_inputs(spark, folder)).where("elite >= 0.5")
    return scored.groupBy("file_id").agg(F.count("*").alias("terms_matched"), F.sum("tf").alias("occurrences"), F.round(F.sum("tf_idf"), 6).alias("tf_idf"))
