"""Treatment of hot keys: finding them, cutting them into ordered blocks, joining on them.

A key is *hot* when it has at least ``max(floor, rows / MAX_HOT)`` rows. So there are never
more than ``MAX_HOT`` hot keys, whatever the data: that bound is what allows their table to be
collected and broadcast. A key below the limit is left to one task, which sorts ``floor`` rows, or, beyond
``floor * MAX_HOT`` (7 x 10^10) rows of a table, a share of 1 / ``MAX_HOT`` of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper bound of the number of hot keys that can exist at once.
MAX_HOT = 1 << 16
#: Rows that one task is trusted to sort; fewer rows never make a key hot.
FLOOR = 1 << 20
#: Most blocks of a key: the quantile sketch keeps ten entries for each. A key of more than half as many times ``floor`` rows
#: (4 x 10^9) gets as many blocks, which then hold more than ``floor`` rows each.
MAX_BLOCKS = 1 << 13


def hot_keys(df: DataFrame, keys: list[str], floor: int = FLOOR) -> list[Row]:
    """The hot keys of ``df`` with their counts ``_n``; at most ``MAX_HOT`` rows.

    The count of all rows comes from the files' footers where there is no filter. Only if some
    key *could* be hot is the table counted by key, with partial counts before the shuffle.
    Rows with a null among the keys are left out.
    """
    total = df.count()
    if total < floor:
        return []
    least = max(floor, -(-total // MAX_HOT))
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(some).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).collect()


def place_among(sorted_: Column, x: Column, most: int) -> Column:
    """How many of an array in rising order, of up to ``most`` entries, are at most ``x``: a search by halves."""
    halves = F.array(*[F.lit(1 << k) for k in range(max(1, most).bit_length() - 1, -1, -1)])
    return F.aggregate(halves, F.lit(0), lambda at, h: F.when(F.coalesce(F.get(sorted_, at + h - 1) <= x, F.lit(False)), at + h).otherwise(at))


def with_blocks(df: DataFrame, keys: list[str], order: str, out: str = "_blk", floor: int = FLOOR, counted: DataFrame | None = None, hot: list[Row] | None = None) -> tuple[DataFrame, bool]:
    """Add ``out``: 0 for ordinary keys; for hot keys a block number that grows with ``order``.

    The blocks of a hot key hold about ``floor`` rows each: their limits are approximate
    quantiles of ``order``, found by a mergeable sketch over the hot rows alone. Rows with equal
    ``order`` share a block. A null ``order`` goes to block 0. ``counted`` may name a cheaper frame with
    the same keys to count them in, ``hot`` the hot keys where they are known. Returns the frame and whether any key is hot.
    """
    if hot is None:
        hot = hot_keys(df if counted is None else counted, keys, floor)
    if not hot:
        return df.withColumn(out, F.lit(0)), False
    spark = df.sparkSession
    schema = df.select(*keys).schema
    names = spark.createDataFrame([tuple(r[k] for k in keys) + (r["_n"],) for r in hot], schema.add("_of_key", T.LongType()))
    most = max(r["_n"] for r in hot)
    parts = min(MAX_BLOCKS, max(2, -(-most // floor) * 2))
    cuts = [i / parts for i in range(1, parts)]
    # a key with fewer rows than the largest takes every so manieth cut, so all keys together have twice as many cuts as rows / floor
    every = F.greatest(F.lit(1), F.expr(f"CAST({parts} div greatest(2, 2 * ((_of_key + {floor - 1}) div {floor})) AS INT)"))
    limits = (
        df.join(F.broadcast(names), keys)
        .groupBy(*keys, every.alias("_every"))
        .agg(F.percentile_approx(order, cuts, max(10000, 10 * parts)).alias("_cuts"))
        .select(*keys, F.array_distinct(F.filter("_cuts", lambda c, i: (i + 1) % F.col("_every") == 0)).alias("_cuts"))
        .collect()
    )
    limits = spark.createDataFrame([tuple(r[k] for k in keys) + (r["_cuts"],) for r in limits], df.select(*keys).schema.add("_cuts", T.ArrayType(df.schema[order].dataType)))
    blk = F.when(F.col("_cuts").isNull() | F.col(order).isNull(), 0).otherwise(place_among(F.col("_cuts"), F.col(order), parts))
    return df.join(F.broadcast(limits), keys, "left").withColumn(out, blk).drop("_cuts"), True


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], floor: int = FLOOR, counted: DataFrame | None = None, hot: list[Row] | None = None) -> DataFrame:
    """Left join on ``keys`` that survives a hot key in ``left``; ``right`` has each key once.

    ``counted`` may name a cheaper frame to count the keys in (a table that ``left`` derives from), ``hot`` the hot keys where they are known.

    The rows of ``right`` that belong to hot keys are bounded by ``MAX_HOT`` and broadcast; the
    other keys take the ordinary shuffle join.
    """
    if hot is None:
        hot = hot_keys(left if counted is None else counted, keys, floor)
    if not hot:
        return left.join(right, keys, "left")
    spark = left.sparkSession
    names = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], left.select(*keys).schema)
    names = names.withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(names), keys, "left")
    hot_right = right.join(F.broadcast(names.drop("_hot")), keys, "left_semi")
    cols = [*left.columns, *[c for c in right.columns if c not in keys]]
    a = marked.where("_hot").drop("_hot").join(F.broadcast(hot_right), keys, "left").select(*cols)
    b = marked.where("_hot IS NULL").drop("_hot").join(right, keys, "left").select(*cols)
    return a.unionByName(b)


def numbered(df: DataFrame, order: list, out: str, start: int = 0) -> DataFrame:
    """``out``: the place of each row in the order of all, without sorting all rows in one task.

    Rows are range partitioned and sorted, written, and counted by partition; each row's place is that in its
    partition plus the rows of the partitions before. ``order`` must be without ties for the numbers to be unique.
    """
    from dyadica.session import stored

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    at, before = start, []
    for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():  # one row per partition
        before.append((r["_part"], at))
        at += r["n"]
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before bigint")
    return ranged.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
