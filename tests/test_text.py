import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataquery.functions import text as X


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_tokens_are_split_before_they_are_lowered(spark):
    got = one(spark, X.tokens, "private readonly HttpClient _client;", "İx a ΑΣ токен 検索 x1", "", None, "a-b c_d")
    assert got == [["private", "readonly", "httpclient", "_client"], ["i̇x", "ας", "токен", "検索", "x1"], [], None, ["c_d"]]


def test_lines(spark):
    assert one(spark, X.lines, "a\r\nb\n", "", "x", "\n", "a\n\nb") == [["a", "b"], [], ["x"], [""], ["a", "", "b"]]


def test_trigrams_of_short_tokens(spark):
    assert one(spark, X.trigrams, "abcd", "abc", "ab", "") == [["abc", "bcd"], ["abc"], [], []]


def test_paths(spark):
    assert one(spark, X.stem, "a/b.test.ts", "a/.env", "c", "x.y/d") == ["b.test", ".env", "c", "d"]
    assert one(spark, X.clean, "a\\b//c/", "./a", ".", "././x") == ["a/b/c", "a", "", "x"]
    assert one(spark, lambda c: X.under(c, "Src/"), "src/a", "src", "srcs/a", "SRC/x/y") == [True, False, False, True]
    assert one(spark, lambda c: X.excluded(c, "bin"), "a/bin/x", "bin/x", "a/bins/x", "x/bin") == [True, True, False, False]
    assert one(spark, X.extension, "a.CS", "a.b/c", "x.tar.gz") == ["cs", "", "gz"]
    assert one(spark, X.directory, "a/b/c.x", "c.x") == ["a/b", ""]


def test_scope_in_one_predicate(spark):
    df = spark.createDataFrame([("src/a/Cache.cs",), ("src/test/Cache.cs",), ("lib/Cache.cs",), ("src/a/x.ts",)], "p string")
    scope = X.in_scope(F.col("p"), "src", files=["cache", "x."], extensions=["CS"], exclude_dirs=["test"], exclude=["zzz"])
    assert rows(df.where(scope)) == [("src/a/Cache.cs",)]


def test_tiers(spark):
    assert one(spark, lambda c: X.match_tier(c, ["cache", "tile"]), "Cache", "cacheReader", "myCache", "TILE") == [0, 1, 2, 0]


@pytest.mark.parametrize(("glob", "name", "hit"), [("*Ca?he*.cs", "MyCacheX.cs", True), ("Tile*", "TileX.rs", True), ("Tile", "TileX", False), ("a.b", "axb", False), ("a?", "ab", True), ("a?", "a", False)])
def test_globs(glob, name, hit):
    import re

    assert bool(re.search(X.glob_pattern(glob), name)) == hit


def test_fnv1a():
    assert X.fnv1a("") == 0xCBF29CE484222325
    assert X.fnv1a("a") == 0xAF63DC4C8601EC8C


@given(st.text(max_size=40))
def test_fnv1a_is_64_bits(text):
    assert 0 <= X.fnv1a(text) < 1 << 64


def test_every_component_has_its_own_template(spark):
    text = "@Component({\n  selector: 'app-a',\n  template: `<app-b></app-b>`\n})\nclass A {}\n@Component({template: `<app-c/>`, selector: 'app-b'})\nclass B {}\n@Directive({ selector: 'app-d' })\nclass D {}\n@Component ( { selector: 'app-e', templateUrl: 'e.html' })"
    df = spark.createDataFrame([(text,), ("no component",), (None,)], "text string")
    found = [tuple(c) for r in df.select(X.components(F.col("text")).alias("c")).collect() for c in r.c or [] if c.selector or c.template]
    assert found == [("app-a", "<app-b></app-b>"), ("app-b", "<app-c/>"), ("app-d", ""), ("app-e", "")]
