import random

from conftest import rows
from pyspark.sql import functions as F

from strataquery.functions.fuzzy import jaro, jaro_winkler
from strataquery.operators.components import components
from strataquery.plans.skew import hot_keys, maybe_broadcast, salted_join


def test_salted_join_like_a_join(spark):
    random.seed(1)
    big = spark.createDataFrame([(random.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(500)], "k string, x int")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), ("c", 4), (None, 5)], "k string, y int")
    sizes = big.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = salted_join(big, small, ["k"], sizes, "n", F.xxhash64("x"), how=how, salts=5, least=50)
        assert rows(got, "k", "x", "y") == rows(big.join(small, "k", how), "k", "x", "y")
    twice = big.union(big)
    got = salted_join(twice, small, ["k"], sizes, "n", F.xxhash64("x"), salts=5, least=50, once_per=["x"])
    assert rows(got, "k", "x", "y") == rows(big.join(small, "k"), "k", "x", "y")


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(1000)
    assert "broadcast" in maybe_broadcast(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in maybe_broadcast(df, limit=10)._jdf.queryExecution().logical().toString().lower()


def test_components_like_union_find(spark):
    for seed in range(3):
        random.seed(seed)
        edges = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(1000, i) for i in range(1001, 1060)] + [(i, i + 1) for i in range(2000, 2040)]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = sorted((find(a), find(b)))
                root[b] = a
        expected = sorted((x, find(x)) for x in {n for a, b in edges for n in (a, b) if a != b})
        assert sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == expected
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def test_jaro_winkler_known_values():
    for a, b, score in (("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("", "", 1.0), ("a", "", 0.0), ("same", "same", 1.0)):
        assert round(jaro_winkler(a, b), 6) == score


def test_jaro_like_its_definition():
    def slow(a, b):
        if a == b:
            return 1.0
        reach, free, mine = max(max(len(a), len(b)) // 2 - 1, 0), [True] * len(b), []
        for i, c in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if free[j] and b[j] == c:
                    free[j] = False
                    mine.append(c)
                    break
        if not mine:
            return 0.0
        theirs = [c for c, f in zip(b, free, strict=True) if not f]
        k, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
        return (k / len(a) + k / len(b) + (k - swaps) / k) / 3

    random.seed(5)
    for _ in range(3000):
        a, b = ("".join(random.choices("abcd", k=random.randrange(12))) for _ in range(2))
        assert jaro(a, b) == slow(a, b)
    assert jaro("ab" * 50_000, "ba" * 50_000) > 0.8


def test_pieces_follow_the_size(spark):
    sizes = spark.createDataFrame([("a", 4_000_000_000), ("b", 10), ("c", 6_000_000_000), ("d", 60_000)], "k string, n long")
    assert rows(hot_keys(sizes, ["k"], "n")) == [("a", 2000), ("c", 3000)]
