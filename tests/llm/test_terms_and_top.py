import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from strataquery.llm import distinctive as D
from strataquery.llm import topn as T

POSTINGS = "token string, file_id long, lines array<int>, tf int"


def test_two_poisson_finds_both_rates():
    rng = np.random.default_rng(0)
    counts = np.r_[rng.poisson(0.2, 9000), rng.poisson(6.0, 1000)]
    k, c = np.unique(counts[counts > 0], return_counts=True)
    share, elite, base = D.fit_two_poisson(np.zeros(len(k), int), k.astype(float), c.astype(float), np.array([10_000.0]), rounds=200)
    assert share[0] == pytest.approx(0.1, abs=0.02) and elite[0] == pytest.approx(6, abs=0.4) and base[0] == pytest.approx(0.2, abs=0.05)


def test_scores_by_hand(spark):
    raw = [("Foo", 1, [1, 2], 9), ("foo", 1, [3], None), ("foo", 1, [3], 1), ("bar", 1, [1], 1), ("bar", 2, [1, 1], 2), ("baz", 2, [5], 1), ("foo", 9, [1], 1), (None, 1, [1], 1), ("x", None, [1], 1), ("y", 1, [], 0), ("z", 2, None, None)]
    stats = spark.createDataFrame([(1, "clash"), (1, "clash"), (2, None), (3, "n"), (None, "x")], "file_id long, n string")
    got = {(r.file_id, r.token): r for r in D.distinctive_terms(spark.createDataFrame(raw, POSTINGS), stats).collect()}
    assert set(got) == {(1, "foo"), (1, "bar"), (2, "bar"), (2, "baz")}
    assert (got[1, "foo"].tf, got[1, "foo"].n, got[1, "foo"].df) == (3, 4, 1)
    assert got[1, "foo"].tf_idf == pytest.approx(round(3 / 4 * np.log(2), 9)) and got[2, "bar"].tf_idf == 0
    assert all(0 <= r.elite <= 1 for r in got.values())


def test_ties_by_code_points_and_short_files(spark):
    raw = [(t, f, [1], 1) for t in ("b", "a", "Z", "ä", "日", "c", "_") for f in (1, 2)] + [("only", 1, [1], 1), ("q", 3, [1], 1)]
    scored = D.distinctive_terms(spark.createDataFrame(raw, POSTINGS), spark.createDataFrame([(i,) for i in (1, 2, 3)], "file_id long"))
    assert rows(D.telling(scored).where("file_id = 2"), "token") == [("_",), ("a",), ("b",), ("c",), ("z",)]
    assert rows(D.telling(scored).where("file_id = 3"), "token") == []


def test_terms_of_nothing(spark):
    empty, stats = spark.createDataFrame([], POSTINGS), spark.createDataFrame([(1,)], "file_id long")
    assert rows(D.distinctive_terms(empty, stats)) == []
    assert rows(D.distinctive_terms(spark.createDataFrame([("a", 1, [1], 1)], POSTINGS), stats.where("false"))) == []


@pytest.mark.parametrize("seed", range(3))
def test_top_n_like_brute_force(spark, seed):
    random.seed(seed)
    data = [(random.choice(["hot"] * 30 + list("abcdefgh") + [None]), random.choice([None, float("nan"), -5.0, 0.0, 1.5, 1e9, random.random() * 50]), random.randrange(4), i, "x") for i in range(1500)]
    groups = {}
    for r in data:
        if r[0] is not None:
            groups.setdefault(r[0], []).append(r)
    order = lambda r: (r[1] is None or r[1] != r[1], -(r[1] or 0) if r[1] == r[1] else 0, r[2], r[3])
    expected = sorted((g, r[3], i) for g, rs in groups.items() for i, r in enumerate(sorted(rs, key=order)[:4], 1))
    df = spark.createDataFrame(data, "g string, s double, t int, id int, floor string")
    assert sorted((r.g, r.id, r["rank"]) for r in T.top_n(df, "g", "s", [F.col("t"), F.col("id")], 4).collect()) == expected


def test_buckets_keep_the_order(spark):
    values = sorted([random.uniform(-1e6, 1e6) for _ in range(400)] + [0.0, -0.5, 0.5, 1e300, -1e300])
    buckets = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", T.score_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_most_complex(spark):
    definitions = spark.createDataFrame([(1, 7, "a"), (1, 7, "a"), (2, 7, "b"), (3, 7, "c"), (4, 7, "d"), (5, None, "e"), (6, 8, "f"), (None, 8, "g")], "def_id long, file_id long, floor string")
    stats = [(1, 5, 1, 1), (1, 2, 9, 2), (1, 2, 9, 2), (2, 2, None, 1), (3, None, 4, 1), (4, 9, 9, None), (4, 3, 0, 1), (6, -1, -2, 1), (99, 1, 1, 1), (None, 1, 1, 1)]
    df = spark.createDataFrame(stats, "def_id long, cyclomatic_complexity int, cognitive_complexity int, at long").withColumn("parsed_at", F.timestamp_seconds("at"))
    assert rows(T.most_complex(definitions, df, 3), "file_id", "def_id", "cyclomatic", "cognitive", "rank") == [(7, 1, 2, 9, 2), (7, 2, 2, 0, 3), (7, 4, 3, 0, 1), (8, 6, -1, -2, 1)]
    assert rows(T.most_complex(definitions, df.where("false"))) == rows(T.most_complex(definitions.where("false"), df)) == []
