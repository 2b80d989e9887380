import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strataquery.operators import hierarchy as H

SCHEMA = "def_id long, file_id long, name string, kind string, parent string"
NO_LIMIT, ALL_JOINS = 100_000, 0


def made(seed, files=4, per_file=40):
    random.seed(seed)
    out, number = [], 0
    for file in range(files):
        names = [f"C{i}" for i in range(per_file // 2)]
        for i, name in enumerate(names):
            number += 1
            parent = random.choice([None, "", " ", names[i - 1] if i else None, random.choice(names), f"ns.{random.choice(names)}<T, List<int>> ", "gone"])
            out.append((number, file if file else None if random.random() < 0.1 else 0, name, random.choice(["class", "table", "xmlElement"]), parent))
        for _ in range(per_file // 2):
            number += 1
            out.append((number, file, random.choice(["m", "n", None]), random.choice(["method", None]), random.choice([*names[:3], f"A::{names[0]}", None])))
    return out + random.sample(out, 8)


def brute(data):
    def bare(p):
        if p is None:
            return None
        while "<" in p and ">" in p:
            i = p.rindex("<")
            p = p[:i] + p[p.index(">", i) + 1 :]
        return p.split("::")[-1].split(".")[-1].strip() or None

    data = {d for d in data if d[1] is not None}
    holders = {}
    for d, f, n, k, _ in sorted(data, key=lambda r: -r[0]):
        if k in H.CONTAINER_KINDS and n is not None:
            holders[f, n] = d
    up = {d: holders.get((f, bare(p))) if bare(p) else None for d, f, n, k, p in data}
    pairs = set()
    for d in up:
        x, seen = up[d], set()
        while x is not None and x not in seen:
            seen.add(x)
            if x != d:
                pairs.add((min(x, d), max(x, d)))
            x = up[x]
    return sorted(pairs), up


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [NO_LIMIT, ALL_JOINS])
def test_pairs_like_brute_force(spark, seed, limit):
    data = made(seed)
    df = spark.createDataFrame(data, SCHEMA).withColumn("n", F.lit(1)).withColumn("ancestors", F.lit("clash"))
    assert rows(H.related_pairs(df, limit)) == sorted(brute(data)[0], key=repr)


def test_hierarchy_depth_path_root(spark):
    data = [(1, 1, "A", "class", None), (2, 1, "B", "class", "A"), (3, 1, "m", "method", "x.B<T>"), (4, 1, "P", "class", "Q"), (5, 1, "Q", "class", "P"), (6, 1, "R", "class", "Q"), (7, 1, "z", "field", None), (3, 1, "m", "method", "x.B<T>")]
    for limit in (NO_LIMIT, ALL_JOINS):
        got = {r.def_id: r for r in H.hierarchy(spark.createDataFrame(data, SCHEMA), limit).collect()}
        assert len(got) == 7
        assert (got[3].path, got[3].depth, got[3].root_id, got[3].parent_id) == ("A/B/m", 2, 1, 2)
        assert (got[7].path, got[7].depth, got[7].root_id, got[7].parent_id) == ("z", 0, 7, None)
        assert got[4].in_cycle and got[5].in_cycle and not got[6].in_cycle
        assert (got[6].root_id, got[6].depth, got[5].root_id) == (4, 1, 4)
        assert (got[1].containers_below, got[4].containers_below) == (1, 2)


def test_deep_chain_is_cut_into_rows(spark):
    n = 6000
    data = [(i, 1, f"C{i}", "class", f"C{i - 1}" if i else None) for i in range(n)]
    trees = H.forest(spark.createDataFrame(data, SCHEMA), with_paths=False)
    assert trees.agg(F.sum(F.size("ancestors"))).first()[0] == n * (n + 1) // 2
    assert trees.where("part = 1").count() == n - H.ROW_ANCESTORS
    assert trees.select("chain").distinct().count() == 1


def test_empty_and_null(spark):
    for data in ([], [(1, None, "A", "class", None), (None, 1, "B", "class", "A"), (2, 1, None, "class", "B"), (3, 1, None, None, None)]):
        assert rows(H.related_pairs(spark.createDataFrame(data, SCHEMA))) == []


def test_hot_holder(spark):
    data = [(0, 1, "A", "class", None)] + [(i, 1, "m", "method", "A") for i in range(1, 3001)]
    assert H.related_pairs(spark.createDataFrame(data, SCHEMA)).count() == 3000


@pytest.mark.parametrize(
    ("parent", "expected"),
    [("A<B<C<D<E<F<G<H<I<J<K>>>>>>>>>>", "A"), ("n.A<x.B>", "A"), ("A<B<C>", "A"), ("A<B>C<D", "AC"), ("A<B C<D>E", "A"), ("A>B<C>", "A>B"), ("<" * 3000 + ">" * 3000 + "x::Y", "Y"), (" A ", "A"), ("<>", None), ("", None), (None, None)],
)
def test_bare_names_at_any_depth(spark, parent, expected):
    df = spark.createDataFrame([(parent,)], "p string")
    assert df.select(H.bare_name(df.p)).first()[0] == expected
