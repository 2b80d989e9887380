"""Joins and sizes that hold when one key owns a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.session import stored

#: A key is hot from this share of the large side on, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 512
#: Most rows of one piece of a hot key, whatever the size of the whole; the pieces follow from the key's size.
PIECE_ROWS = 2_000_000
#: What may be broadcast, in rows and bytes; both are measured or proven before the hint is given.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of df's plan as the optimizer knows it; without statistics this is huge, never too small."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its plan is known to stay under limit bytes, else as it is."""
    return F.broadcast(df) if input_bytes(df) <= limit else df


def hot_keys(sizes: DataFrame, keys: list[str], size: str, share: int = HOT_SHARE, least: int = 50_000) -> DataFrame:
    """Keys of sizes (one row per key, column size) that own at least 1/share of the total and at least `least` rows.

    At most `share` rows by construction, hence safe to broadcast. `__pieces` is how many tasks a key is worth:
    pieces of 1/share of the total, of at least `least` and at most PIECE_ROWS rows.
    """
    total = sizes.agg(F.sum(size)).scalar()
    piece = F.least(F.greatest(total / share, F.lit(least)), F.greatest(F.lit(PIECE_ROWS), F.lit(least)))
    return sizes.where((F.col(size) >= least) & (F.col(size) * share >= total)).select(*keys, F.greatest(F.ceil(F.col(size) / piece), F.lit(2)).cast("int").alias("__pieces"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    sizes: DataFrame,
    size: str,
    spread: Column,
    how: str = "inner",
    salts: int | None = None,
    least: int = 50_000,
    once_per: list[str] | None = None,
) -> DataFrame:
    """Equi-join of big with small on keys; hot keys are split over as many tasks as their size asks for.

    sizes has one row per key and its number of rows in big. spread is an expression over big that
    scatters the rows of one key evenly and is equal for equal rows (a hash of its row id). Rows of
    small with hot keys are repeated once per salt; all others meet under salt 0. Null keys never match.
    salts: a fixed number of pieces in place of hot_keys'. once_per: columns of big; rows equal in these
    and the keys are joined once, without a further shuffle.
    """
    hot = F.broadcast(hot_keys(sizes, keys, size, least=least))
    if salts:
        hot = hot.withColumn("__pieces", F.lit(salts))
    left = big.join(hot, keys, "left").withColumn("__salt", F.coalesce(F.pmod(spread, F.col("__pieces")), F.lit(0)).cast("int")).drop("__pieces")
    if once_per:
        left = left.repartition(*keys, "__salt").dropDuplicates([*keys, "__salt", *once_per])
    right = (
        small.join(hot, keys, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__pieces") - 1, F.lit(0)))))
        .drop("__pieces")
    )
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with dense numbers from 0 in an order, without one task seeing all rows: ranges of the order count by themselves."""
    spark = df.sparkSession
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()  # one row per partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["__part"], total))
        total += r["n"]
    before = F.broadcast(spark.createDataFrame(starts, "__part long, __before long"))
    return ranged.withColumn("__part", part).join(before, "__part").withColumn(name, F.col("__before") + place).select(*df.columns, name)
