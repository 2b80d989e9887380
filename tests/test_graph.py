import random

from conftest import rows
from pyspark.sql import functions as F

from strataquery.operators import graph as G
from strataquery.operators import symbols as Y


def test_reach_like_breadth_first(spark):
    random.seed(4)
    edges = {(random.randrange(30), random.randrange(30)) for _ in range(45)}
    expected = []
    for root in (0, 5):
        level, depth, seen = {root}, 0, {root: 0}
        while level and depth < 4:
            depth += 1
            level = {b for a, b in edges if a in level} - set(seen)
            seen |= dict.fromkeys(level, depth)
        expected += [(root, n, d) for n, d in seen.items()]
    got = G.reach(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(0, 0), (5, 5)], "root long, node long"), 4)
    assert rows(got) == sorted(expected, key=repr)


def test_caps_chains_and_stops(spark):
    edges = spark.createDataFrame([("r", x) for x in "abcd"] + [("a", "t"), ("t", "z")], "src string, dst string")
    roots = spark.createDataFrame([("r", "r")], "root string, node string")
    assert rows(G.reach(edges, roots, 1, per_level=2), "node") == [("a",), ("b",), ("r",)]
    got = G.reach(edges, roots, 5, chains=True, stop=F.col("node") == "t")
    assert rows(got.where("node in ('t', 'z')"), "node", "chain") == [("t", ("r", "a", "t"))]
    assert G.within_budget(G.reach(edges, roots, 5), 3).count() == 3
    assert G.reach(edges.where("false"), roots, 3).count() == 1


def test_fuzzy_interfaces(spark):
    pairs = [("DataModelService", "IDataModelService", True), ("MyDataModelServiceImpl", "IDataModelService", True), ("DataModelWebService", "IDataModelService", True), ("DataProcessor", "IDataModelService", False), ("Foo", "IFoo", True), ("Foobar", "IFoo", False), ("face", "Iface", False)]
    df = spark.createDataFrame(pairs, "c string, i string, expected boolean")
    assert df.where(G.implements(F.col("c"), F.col("i")) != F.col("expected")).count() == 0


def test_overload_binding():
    p = lambda name, kind, **more: {"name": name, "type": kind, "ref": None, "optional": False, "rest": False, **more}
    assert G.binds([], [])
    assert not G.binds([{"type": "int"}], [])
    assert G.binds([{"name": "b", "type": "int"}, {"name": "a", "type": None}], [p("a", "x"), p("b", "int")])
    assert not G.binds([{"name": "a", "type": None}, {"name": "a", "type": None}], [p("a", "x"), p("b", "y", optional=True)])
    assert not G.binds([{"type": "int"}], [p("a", "int")], arity=1, generic_arity=0)
    assert G.binds([], [p("a", "int[]", rest=True)])
    assert not G.binds([{"type": "int[]"}, {"type": "int[]"}], [p("a", "int[]", rest=True)])


def test_covering_spans(spark):
    random.seed(1)
    spans = [(i, i % 3, a := random.randrange(300), a + random.randrange(200)) for i in range(150)]
    points = [(i, i % 3, random.randrange(500)) for i in range(80)]
    expected = sorted((p, s) for p, f, line in points for s, g, a, b in spans if f == g and a <= line <= b)
    df = Y.covering(spark.createDataFrame(points, "p long, file_id long, line int"), spark.createDataFrame(spans, "def_id long, file_id long, line_start int, line_end int"))
    assert sorted((r.p, r.def_id) for r in df.collect()) == expected


def test_tests_are_known_by_attribute_and_file(spark):
    data = [(["NUnit.TestCase(1)"], "a.cs", True), (["cfg(all(unix, test))"], "a.rs", True), (["cfg(testing)"], "a.rs", False), (["FactAttribute"], "a.cs", True), ([], "x.spec.ts", True), (None, "a.cs", False), (["Latest"], "a.cs", False)]
    df = spark.createDataFrame(data, "attributes array<string>, path string, expected boolean")
    assert df.where(Y.is_test(F.col("path")) != F.col("expected")).count() == 0


def test_corrections_spare_versions(spark):
    names = spark.createDataFrame([("Report2023",), ("CacheReader",), (None,)], "name string")
    asked = spark.createDataFrame([("Report2024",), ("CacheRaeder",), ("zz",)], "asked string")
    assert rows(Y.corrected(names, asked), "asked", "name") == [("CacheRaeder", "CacheReader")]


def test_walks_without_a_bound_reach_their_ends(spark):
    from strataquery.operators.history import ahead_behind

    line = [(i + 1, i) for i in range(90)] + [(200, 40)]
    edges = spark.createDataFrame(line, "src int, dst int")
    one = lambda n: spark.createDataFrame([(n,)], "node int")
    assert rows(ahead_behind(edges, one(90), one(200))) == [(50, 1)]


def test_siblings_come_at_the_same_depth(spark):
    edges = spark.createDataFrame([("a", "b1"), ("b2", "c")], "src string, dst string")
    siblings = spark.createDataFrame([("b1", "I.b"), ("b2", "I.b"), ("x", "I.x")], "node string, group string")
    roots = spark.createDataFrame([("a", "a")], "root string, node string")
    assert rows(G.reach(edges, roots, 3, siblings=siblings), "node", "depth") == [("a", 0), ("b1", 1), ("b2", 1), ("c", 2)]
    assert rows(G.reach(edges, roots, 3), "node", "depth") == [("a", 0), ("b1", 1)]


def test_ends_are_exempt_from_the_cap(spark):
    edges = spark.createDataFrame([("a", x) for x in ("b", "c", "d", "t1", "t2")] + [("t1", "z"), ("b", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a", "a")], "root string, node string")
    stop = spark.createDataFrame([("t1",), ("t2",)], "node string")
    assert rows(G.reach(edges, roots, 3, per_level=1, stop=stop), "node") == [("a",), ("b",), ("t1",), ("t2",), ("y",)]
