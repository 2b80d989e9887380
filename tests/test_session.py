import os

from strataquery.session import forget, lasting, scope, scratch, shared_dir, stored


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_a_scope_removes_what_was_stored_in_it(spark):
    before = stored(spark.range(3), "before")
    with scope(spark):
        inner = stored(spark.range(4), "inner")
        with lasting():
            kept = scratch(spark, "kept")
            spark.range(5).write.parquet(kept)
        assert inner.count() == 4 and os.path.isdir(local(inner.stored_at))
    assert not os.path.isdir(local(inner.stored_at)) and before.count() == 3 and spark.read.parquet(kept).count() == 5
    forget(before, spark.range(1))
    assert not os.path.isdir(local(before.stored_at)) and os.path.isdir(local(shared_dir(spark)))


def test_operators_leave_nothing_behind_in_a_scope(spark):
    from strataquery.operators.components import components

    with scope(spark):
        assert components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")).count() == 5
        made = set(os.listdir(local(shared_dir(spark))))
    assert made - set(os.listdir(local(shared_dir(spark))))
