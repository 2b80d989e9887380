import os

import pytest
from conftest import rows

from strataquery.operators import history as H
from strataquery.operators.evaluation import mean_quality, quality
from strataquery.operators.reconcile import checked_delta, drift
from strataquery.sources import store
from strataquery.streaming.changes import StreamedIndex, last_states, save_points

RS = "\x1e"


def test_log(spark):
    a, b = "a" * 40, "b" * 40
    records = [f"COMMIT:{a}{RS}100{RS}x@y{RS}X{RS}first{RS}rest", "\nsrc\\a.cs", "b.cs", f"COMMIT:bad{RS}1", "lost.cs", f"COMMIT:{b}{RS}200{RS}z@y{RS}Z{RS}", "./b.cs", "b.cs", ""]
    commits, paths = H.read_log(spark.createDataFrame(list(enumerate(records)), "seq int, record string"))
    assert rows(commits, "hash", "name", "subject") == sorted([(a, "X", f"first{RS}rest"), (b, "Z", "")], key=repr)
    assert rows(paths) == sorted([("src/a.cs", a), ("b.cs", a), ("b.cs", b)], key=repr)


def test_blame(spark):
    a, b = "a" * 40, "b" * 40
    lines = [f"{a} 1 1 2", "author Ann", "author-mail <ann@x>", "author-time 100", "filename f", "\tone", f"{a} 2 2", "\ttwo", f"{b} 1 3 1", "author Bob", "author-mail <bob@x>", "author-time 50", "\tthree"]
    got = H.read_blame(spark.createDataFrame([("f", i, s) for i, s in enumerate(lines)], "path string, seq int, line string"))
    assert rows(got, "line_no", "hash8", "name", "email", "content") == [(1, "a" * 8, "Ann", "ann@x", "one"), (2, "a" * 8, "Ann", "ann@x", "two"), (3, "b" * 8, "Bob", "bob@x", "three")]


def test_quality_by_hand(spark):
    runs = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")], "query_id string, rank int, path string")
    judged = spark.createDataFrame([("q", "a", 1), ("q", "c", 3), ("q", "b", 0), ("q", "d", 2), ("r", "a", 3)], "query_id string, path string, grade int")
    per = quality(runs, judged)
    dcg, ideal = 1 + 7 / 2, 7 + 3 / 1.584962500721156 + 1 / 2
    assert rows(per) == sorted([("q", round(dcg / ideal, 6), round(1 / 3, 6), round(2 / 3, 6), 0, 1), ("r", 0.0, 0.0, 0.0, 0, 0)], key=repr)
    assert mean_quality(per).first().n_queries == 2


def test_drift(spark):
    old, new = (spark.createDataFrame(x, "k string, v string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("b", "2"), ("c", "1"), ("d", "1")]))
    assert rows(drift(old, new, "k", "v")) == [("a", "removed"), ("b", "modified"), ("d", "added")]


def test_files_and_encodings(spark, tmp_path):
    for name, content in (("a.cs", "é".encode()), ("sub/b.cs", "﻿hi".encode("utf-16-le")), ("sub/c.CS", b"\xfe\xff\x00x"), ("d.txt", b"no"), (".git/e.cs", b"no"), ("f.cs", b"\xef\xbb\xbfok"), ("obj/g.cs", b"no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    listed = store.files(spark, str(tmp_path), ["cs"], ignore=["^obj/"], content=True)
    assert rows(listed, "path", "text") == sorted([("a.cs", "é"), ("sub/b.cs", "hi"), ("sub/c.CS", "x"), ("f.cs", "ok")], key=repr)
    assert rows(store.with_folders(listed).where("is_dir"), "path") == [("sub",)]


def test_datasets_grow_old(spark, tmp_path):
    made = store.Dataset(spark, str(tmp_path / store.index_name("/r", ["cs"])))
    made.write(spark.range(10), "/r", ["cs"], max_age=100)
    assert made.read().count() == 10 and not made.stale() and made.stale(made.meta()["created"] + 101)
    metas = spark.createDataFrame([("x", "/r"), ("y", "/gone")], "name string, root string")
    assert rows(store.orphans(metas, spark.createDataFrame([("/r",)], "root string")), "name") == [("y",)]


def test_page_tokens():
    token = store.page_token(3, 20, {"terms": ["a"]})
    assert store.page_from(token, 3, {"terms": ["a"]}) == 20
    for epoch, request, text in ((4, {"terms": ["a"]}, "changed"), (3, {"terms": ["b"]}, "another")):
        with pytest.raises(ValueError, match=text):
            store.page_from(token, epoch, request)
    with pytest.raises(ValueError, match="no page token"):
        store.page_from("x", 3, {})
    with pytest.raises(ValueError, match="maxResults"):
        store.checked_arguments({"maxResult": 1}, ["maxResults", "terms"])


def test_streamed_index_like_a_rebuild(spark, tmp_path):
    schema = "path string, op string, ts long, text string"
    batches = [
        [("a", "create", 1, "one two"), ("b", "create", 1, "two"), (".git/x", "create", 1, "no"), ("b", "modify", 2, "three three")],
        [("a", "modify", 3, None), ("c", "create", 3, "four"), ("b", "remove", 4, None)],
    ]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for f in os.listdir(tmp_path / f"in/{i}"):
            if f.endswith(".parquet"):
                (tmp_path / "files").mkdir(exist_ok=True)
                os.rename(tmp_path / f"in/{i}" / f, tmp_path / "files" / f"{i}.parquet")
    index = StreamedIndex(spark, str(tmp_path / "index"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "files"))
    got = index.run(events)
    assert rows(got, "token", "tf") == [("four", 1), ("one", 1), ("two", 1)]
    assert rows(index.read(0), "token", "tf") == [("one", 1), ("three", 2), ("two", 1)]
    index.apply(spark.createDataFrame(batches[1], schema), 1)  # a batch run again changes nothing
    assert rows(index.read(), "token", "tf") == [("four", 1), ("one", 1), ("two", 1)]


def test_last_state_wins(spark):
    df = spark.createDataFrame([("a", "modify", 1, "x"), ("a", "remove", 2, None), ("sub/.git/c", "modify", 1, "x")], "path string, op string, ts long, text string")
    assert rows(last_states(df)) == [("a", "remove", None)]


def test_streamed_index_goes_on_after_it_was_opened_again(spark, tmp_path):
    schema = "path string, op string, ts long, text string"
    index = StreamedIndex(spark, str(tmp_path / "index"))
    index.apply(spark.createDataFrame([("a", "create", 1, "one two"), ("b", "create", 1, "two")], schema), 0)
    again = StreamedIndex(spark, str(tmp_path / "index"))
    assert again.version == 0 and rows(again.read(), "token", "tf") == [("one", 1), ("two", 1), ("two", 1)]
    again.apply(spark.createDataFrame([("b", "remove", 2, None)], schema), 1)
    assert rows(StreamedIndex(spark, str(tmp_path / "index")).read(), "token", "tf") == [("one", 1), ("two", 1)]
    again.apply(spark.createDataFrame([("c", "create", 3, "six")], schema), 5)  # a batch number was left out
    assert rows(again.read(), "token", "tf") == [("one", 1), ("six", 1), ("two", 1)] and rows(again.read(3), "token", "tf") == [("one", 1), ("two", 1)]


def test_streamed_index_is_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("strataquery.streaming.changes.FOLD_AFTER", 2)
    schema = "path string, op string, ts long, text string"
    index = StreamedIndex(spark, str(tmp_path / "index"))
    for i in range(5):
        index.apply(spark.createDataFrame([("a", "modify", i, f"word{i}"), (f"f{i}", "create", i, "same")], schema), i)
        assert len(index._manifest(i)["deltas"]) <= 2
    assert rows(index.read(), "token", "tf") == [("same", 1)] * 5 + [("word4", 1)]


def test_a_description_is_replaced_without_a_gap(spark, tmp_path):
    path = str(tmp_path / "d.json")
    for value in ({"a": 1}, {"a": 2}):
        store.write_json(spark, path, value)
        assert store.read_json(spark, path) == value
    assert [f for f in os.listdir(tmp_path) if f.endswith(".staged")] == []


def test_kept_tables_are_built_once_per_state(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return {"t": spark.read.parquet(str(tmp_path / "in"))}, lambda written: {"n": written["t"].count()}

    spark.range(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        tables, figures = store.kept(spark, "test", [str(tmp_path / "in")], build)
        assert figures == {"n": 3} and tables["t"].count() == 3
    assert len(built) == 1
    spark.range(5).write.mode("append").parquet(str(tmp_path / "in"))
    assert store.kept(spark, "test", [str(tmp_path / "in")], build)[1] == {"n": 8} and len(built) == 2


def test_deltas_hold_for_their_inputs_only(spark):
    parsed = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 3), ("d", "1", 1)], "path string, digest string, attempt int")
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2")], "path string, digest string")
    assert rows(checked_delta(parsed, current)) == [("a", "apply"), ("b", "again"), ("c", "keep old"), ("d", "remove")]


def test_save_points(spark):
    seconds = [0, 60, 120, 2000, *range(4000, 4000 + 1500, 100)]
    df = spark.createDataFrame([("k", s) for s in seconds], "key string, s long").selectExpr("key", "timestamp_seconds(s) ts")
    got = rows(save_points(df).selectExpr("unix_seconds(save_ts) s", "n_changes"))
    assert sorted(got) == [(420, 3), (2300, 1), (4600, 6), (5200, 6), (5700, 3)]


@pytest.mark.parametrize(
    ("rules", "left"),
    [(["*.cs"], ["b/c.ts", "build/x.ts"]), (["/a.cs"], ["b/a.cs", "b/c.ts", "build/x.ts"]), (["build/"], ["a.cs", "b/a.cs", "b/c.ts"]), (["*", "!b/*.ts"], ["b/c.ts"]), (["b/**"], ["a.cs", "build/x.ts"]), (["**/a.cs", "# x", ""], ["b/c.ts", "build/x.ts"]), (["b?ild"], ["a.cs", "b/a.cs", "b/c.ts"])],
)
def test_ignore_rules(spark, rules, left):
    df = spark.createDataFrame([(p,) for p in ("a.cs", "b/a.cs", "b/c.ts", "build/x.ts")], "path string")
    assert rows_of(df.where(~store.ignored(df.path, rules))) == left


def rows_of(df):
    return sorted(r[0] for r in df.collect())


def test_dense_numbers(spark):
    from strataquery.plans.skew import numbered

    df = spark.range(1000).selectExpr("cast(pmod(id * 7919, 1009) as int) x")
    got = numbered(df.repartition(5), ["x"], "n").orderBy("x").collect()
    assert [r.n for r in got] == list(range(1000)) and numbered(df.where("false"), ["x"], "n").collect() == []


def test_functions_in_sql(spark):
    from strataquery.functions.registry import register

    assert "jaro_winkler" in register(spark)
    spark.createDataFrame([("class A { public void F() { } }",), (None,)], "t string").createOrReplaceTempView("texts")
    assert [tuple(r) for r in spark.sql("SELECT s.kind, s.name, s.parent FROM texts, LATERAL code_symbols(texts.t, 'cs') s ORDER BY 1").collect()] == [("class", "A", None), ("method", "F", "A")]
    assert spark.sql("SELECT sql_objects('CREATE TABLE [dbo].[T] (a int)') x").first().x == '[["table", "dbo", "T"]]'
