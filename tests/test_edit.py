import random

import pytest
from pyspark.sql import functions as F

from strataquery.operators import edit as E


def run(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


def test_line_edits(spark):
    edit = lambda e: lambda t: E.edit_lines(t, e)
    assert run(spark, edit([(2, 2, ["x", "y"])]), "a\nb\nc\n", "a", None) == ["a\nx\ny\nc\n", "a", None]
    assert run(spark, edit([(1, 0, ["top"])]), "a\n", "a") == ["top\na\n", "top\na"]
    assert run(spark, edit([(3, 2, ["end"])]), "a\nb\n") == ["a\nb\nend\n"]
    assert run(spark, edit([(1, 2, []), (4, 3, ["new"])]), "a\nb\nc\nd") == ["c\nnew\nd"]
    for bad in ([(1, 3, []), (2, 4, [])], [(0, 1, [])]):
        with pytest.raises(ValueError, match="ranges"):
            E.edit_lines(F.col("t"), bad)


def test_replacements(spark):
    assert run(spark, lambda t: E.replace_nth(t, "a.", "X", 2), "a.b a.c a.d", "a.", "abab") == ["a.b Xc a.d", "a.", "abab"]
    assert run(spark, lambda t: E.replace_nth(t, "aa", "b", 0), "aaaa aa") == ["bb b"]
    assert run(spark, lambda t: E.occurrences_of(t, "ab"), "ab xab", "") == [2, 0]
    with pytest.raises(ValueError, match="nothing"):
        E.replace_nth(F.col("t"), "", "x", 1)


def test_inserts_once(spark):
    once = run(spark, lambda t: E.insert_after(t, "one", "new"), "one\ntwo", "zero\none", "none here", "two")
    assert once == ["one\nnew\ntwo", "zero\none\nnew", "none here\nnew", "two"]
    assert run(spark, lambda t: E.insert_after(t, "one", "new"), once[0]) == [once[0]]


def test_diff_and_nearest(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc"), ("a", "a"), (None, "n")], "p string, q string")
    diffs = [r[0] for r in df.select(E.unified_diff("p", "q")).collect()]
    assert diffs[0].splitlines()[3:6] == [" a", "-b", "+x"] and diffs[1] == "" and diffs[2].endswith("+n")
    long = spark.createDataFrame([("\n".join(map(str, range(500))), "")], "p string, q string")
    assert long.select(E.unified_diff("p", "q")).first()[0].splitlines()[-1].startswith("... ")
    random.seed(0)
    assert E.nearest("alpha\nbeta gamma\ndelta", "beta gama")[0] == 2
    assert E.nearest("alpha", "zzzzzz") is None and E.nearest("", "x") is None and E.nearest("x" * 600_000, "x") is None
