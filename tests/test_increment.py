import random

import pytest
from conftest import rows

from strataquery.operators.increment import IncrementalStore, _node, _ranges, changed_inputs, clean_path
from strataquery.session import scratch


def frame(spark, state):
    return spark.createDataFrame(sorted(state.items(), key=repr), "key string, digest string")


def test_runs_like_a_dictionary(spark):
    random.seed(2)
    store, known = IncrementalStore(spark, scratch(spark, "t")), {}
    state = {f"p{i}": str(random.random()) for i in range(900)}
    for run in range(4):
        seen = dict(random.sample(sorted(state.items()), 800))
        expected = sorted((run, k, v) for k, v in seen.items() if known.get(k) != v)
        assert rows(store.process(run, frame(spark, seen))) == sorted(expected, key=repr)
        known.update(seen)
        for k in random.sample(sorted(state), 20):
            state[k] = str(random.random())
        state[f"new{run}"] = "x"
    assert store.output().count() == sum(store.output(r).count() for r in range(4))


def test_a_run_again_repeats_nothing(spark):
    store = IncrementalStore(spark, scratch(spark, "t"))
    first = rows(store.process(7, frame(spark, {"a": "1", "b": "2"})))
    assert rows(store.process(7, frame(spark, {"a": "9"}))) == first
    assert rows(store.process(8, frame(spark, {"a": "1", "b": "3"}))) == [(8, "b", "3")]


def test_a_run_that_dies_is_lost_whole(spark, monkeypatch):
    store = IncrementalStore(spark, scratch(spark, "t"))
    store.process(1, frame(spark, {"a": "1"}))
    monkeypatch.setattr(IncrementalStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.process(2, frame(spark, {"a": "2", "b": "1"}))
    monkeypatch.undo()
    assert store.manifest()["version"] == 0
    assert rows(store.process(3, frame(spark, {"a": "2"}))) == [(3, "a", "2")]


def test_versions_are_folded(spark, monkeypatch):
    monkeypatch.setattr("strataquery.operators.increment.FOLD_AFTER", 2)
    store = IncrementalStore(spark, scratch(spark, "t"))
    for run in range(4):
        store.process(run, frame(spark, {"a": str(run), "b": "same"}))
    assert len(store.manifest()["parts"]) <= 2
    assert rows(store.process(9, frame(spark, {"a": "3", "b": "other"}))) == [(9, "b", "other")]


def test_nulls_and_empty(spark):
    store = IncrementalStore(spark, scratch(spark, "t"))
    assert rows(store.process(1, spark.createDataFrame([], "key string, digest string"))) == []
    assert rows(store.process(2, frame(spark, {"a": None, None: "1", "": "2"}))) == [(2, "", "2")]


def test_paths(spark):
    df = spark.createDataFrame([(".\\src\\a.cs",), ("././x//y/./z",), (None,), ("",)], "p string")
    assert rows(df.select(clean_path(df.p))) == sorted([("src/a.cs",), ("x/y/./z",), (None,), ("",)], key=repr)


def test_changed_inputs(spark):
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, None), (4, "ok"), (5, "ok"), (4, "ok")], "run_id long, status string")
    seen = [
        (1, 1, "a", "H1", 1), (2, 1, "./b", "h2", 1), (3, 1, "c", None, 1), (4, 1, "a", "hx", 0), (5, 2, "d", "h9", 2), (6, 4, "a", "h1", 5), (7, 4, "b", "h3", 5), (8, 4, "d", "h9", 5),
        (9, 5, "b", None, 9), (10, 5, "c", "h5", 9), (11, 5, "d", "H9", 9), (12, None, "z", "h", 9), (13, 1, "a", "H1", 1),
    ]
    rows_ = spark.createDataFrame(seen, "obs_id long, run_id long, path string, content_hash string, seen_at long")
    rows_ = rows_.selectExpr("obs_id", "run_id", "path", "content_hash", "timestamp_seconds(seen_at) seen_at", "1 as key", "2 as version")
    assert rows(changed_inputs(rows_, runs)) == sorted([(1, "a"), (1, "b"), (4, "b"), (4, "d"), (5, "c")], key=repr)
    assert rows(changed_inputs(rows_, runs.where("false"))) == []
    assert rows(changed_inputs(rows_.where("false"), runs)) == []


def test_few_changes_reach_few_leaves(spark):
    random.seed(4)
    store = IncrementalStore(spark, scratch(spark, "t"))
    state = {f"p{i}": "a" for i in range(30_000)}
    store.process(0, frame(spark, state))
    changed = [f"p{i}" for i in random.sample(range(30_000), 60)]
    state.update(dict.fromkeys(changed, "b"))
    assert rows(store.process(1, frame(spark, state)), "key") == sorted((k,) for k in changed)
    about = store.manifest()
    assert about["descended"] <= 60 and about["descended"] * 5 < about["leaves"]
    for k in random.sample(sorted(state), 100):  # away for good: they make their leaves differ once
        del state[k]
    for run, least in ((2, 1), (3, 0)):
        assert rows(store.process(run, frame(spark, state))) == []
        assert least <= store.manifest()["descended"] <= 100 * least
    state["p7"] = "c"
    assert rows(store.process(4, frame(spark, state))) == [(4, "p7", "c")]
    assert store.manifest()["descended"] == 1


@pytest.mark.parametrize("top", [12, 4, 2])
def test_the_tree_grows(spark, monkeypatch, top):
    monkeypatch.setattr("strataquery.operators.increment.TOP", top)
    monkeypatch.setattr("strataquery.operators.increment.FAN", 2)
    random.seed(5)
    store, known, state = IncrementalStore(spark, scratch(spark, "t")), {}, {"p": "1"}
    depths = []
    for run in range(5):
        seen = {k: v for k, v in state.items() if random.random() < 0.95}
        expected = sorted((run, k, v) for k, v in seen.items() if known.get(k) != v)
        assert rows(store.process(run, frame(spark, seen))) == sorted(expected, key=repr)
        known.update(seen)
        depths.append(store.manifest()["bits"])
        for k in random.sample(sorted(state), len(state) // 20):
            state[k] = str(random.random())
        state.update({f"n{run}-{i}": "x" for i in range(500 * run)})
    assert depths[-1] >= 6 > depths[0]


def test_a_run_without_records_keeps_the_tree(spark):
    store = IncrementalStore(spark, scratch(spark, "t"))
    store.process(1, frame(spark, {"a": "1", "b": "2"}))
    store.process(2, spark.createDataFrame([], "key string, digest string"))
    assert rows(store.process(3, frame(spark, {"a": "1", "b": "3"}))) == [(3, "b", "3")]


def test_ranges_hold_all_keys_below_their_nodes(spark):
    random.seed(6)
    df = spark.range(3000).selectExpr("xxhash64(id) h")
    for bits, nodes in ((0, [0]), (1, [0, 1]), (3, [0, 3, 4, 7]), (12, random.sample(range(4096), 500)), (12, [0, 2047, 2048, 4095])):
        inside = df.where(_node(bits).isin(nodes))
        assert inside.where(~_ranges(nodes, bits)).count() == 0
        if bits == 3:
            assert df.where(_ranges(nodes, bits)).count() == inside.count()


def test_a_store_goes_on_where_it_was_left(spark):
    runs = spark.createDataFrame([(r, "ok") for r in (1, 2, 3)], "run_id long, status string")
    seen = [(r, r, "a", f"h{r // 2}", r) for r in (1, 2, 3)] + [(9, 3, "b", "x", 3)]
    df = spark.createDataFrame(seen, "obs_id long, run_id long, path string, content_hash string, seen_at long").selectExpr("obs_id", "run_id", "path", "content_hash", "timestamp_seconds(seen_at) seen_at")
    folder = scratch(spark, "t")
    assert rows(changed_inputs(df, runs, folder, first=1)) == [(1, "a")]
    assert rows(changed_inputs(df, runs, folder)) == rows(changed_inputs(df, runs)) == [(1, "a"), (2, "a"), (3, "b")]
