"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

Spark's ``session_window`` with a row-specific duration opens a session at each row's start that
lasts until the row's end, and merges sessions that overlap or nest, by a sort in each task.
A pass over the merged sessions joins those that only touch and derives the gaps. A hot entity
is cut into blocks of time that are merged apart; what reaches from one block into the next is
carried by a table of one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadica.operators.skew import FLOOR, all_of, with_blocks

HOUR_US = 3_600_000_000


def _heads(df: DataFrame, keys: list[str], start: str, end: str, floor: int) -> tuple[DataFrame, list[str], list[str]]:
    """One row per merged session: its start and end, ``_prev``, the end of all before it (null at
    the first), ``_reach``, the end of all up to it, and ``_next``, the start of the one after it (null at the last); the names of the keys, and of the unit that is one task's."""
    named = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
    rows = rows.where(all_of([F.col(c).isNotNull() for c in [*named, "_s", "_e"]]) & (F.col("_e") > F.col("_s")) & F.try_subtract("_e", "_s").isNotNull())
    rows, hot = with_blocks(rows, named, "_s", floor=floor, counted=df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)]))
    unit = [*named, "_blk"] if hot else named
    length = F.col("_e") - F.col("_s")
    hours = F.expr(f"(_e - _s) div {HOUR_US}")  # in two halves, since an interval takes hours as an int
    lasting = F.make_interval(hours=F.shiftright(hours, 1).cast("int")) + F.make_interval(hours=(hours - F.shiftright(hours, 1)).cast("int"), secs=(length % HOUR_US).cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)"))
    merged = (
        rows.select(*unit, F.timestamp_micros("_s").alias("_t"), lasting.alias("_d"))
        .groupBy(*unit, F.session_window("_t", F.col("_d")).alias("_w"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*unit, F.unix_micros("_w.start").alias("_s"), F.unix_micros("_w.end").alias("_e"), "_n")
    )
    before = Window.partitionBy(*unit).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    merged = merged.withColumn("_prev", F.max("_e").over(before)).withColumn("_next", F.lead("_s").over(Window.partitionBy(*unit).orderBy("_s")))
    if hot:
        blocks = Window.partitionBy(*named).orderBy("_blk")
        carry = merged.groupBy(*named, "_blk").agg(F.max("_e").alias("_m"), F.min("_s").alias("_first"))
        carry = carry.withColumn("_carry", F.max("_m").over(blocks.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.lead("_first").over(blocks))
        merged = merged.join(carry.drop("_m", "_first"), [*named, "_blk"]).withColumn("_prev", F.greatest("_prev", "_carry")).withColumn("_next", F.coalesce("_next", "_after")).drop("_carry", "_after")
    return merged.withColumn("_reach", F.greatest("_e", "_prev")), named, unit


def gaps(df: DataFrame, keys: list[str], start: str, end: str, *, names: tuple[str, str] = ("gap_start", "gap_end"), floor: int = FLOOR) -> DataFrame:
    """The maximal uncovered stretches between the first and last covered time of each entity.

    Rows with a null key, start or end, or whose end is not after the start, cover nothing; nor do
    rows whose length doesn't fit a bigint. An interval covers its start and not its end, so touching intervals leave no gap; repeated
    rows change nothing; an entity with one period, and an empty table, give no row. Other
    columns of ``df`` are not looked at.
    """
    heads, named, _ = _heads(df, keys, start, end, floor)
    return heads.where(F.col("_next") > F.col("_reach")).select(*[F.col(n).alias(k) for n, k in zip(named, keys)], F.col("_reach").alias(names[0]), F.col("_next").alias(names[1]))


def periods(df: DataFrame, keys: list[str], start: str, end: str, *, names: tuple[str, str] = ("period_start", "period_end"), floor: int = FLOOR) -> DataFrame:
    """The continuous periods of each entity, with ``n_rows``, the intervals merged into each.

    A period begins where a session starts after all before it have ended, and ends with the farthest end among its sessions; what goes on over
    a block's limit is put together from a table of one or two rows per block. The same
    rows cover nothing as in :func:`gaps`.
    """
    sessions, named, unit = _heads(df, keys, start, end, floor)
    hot = unit != named
    w = Window.partitionBy(*unit).orderBy("_s")
    isnew = F.col("_prev").isNull() | (F.col("_s") > F.col("_prev"))
    numbered = sessions.withColumn("_p", F.sum(isnew.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*unit, "_p").agg(F.min("_s").alias("_s"), F.max("_reach").alias("_e"), F.sum("_n").alias("_n"))
    if hot:  # part 0 of a block continues what an earlier block began; there is one such part per block at most
        whole = parts.where("_p > 0").withColumn("_last", F.lead("_s").over(w).isNull())
        edge = whole.where("_last").select(*named, "_blk", "_s", "_e", "_n").unionByName(parts.where("_p = 0").select(*named, "_blk", F.lit(None).cast("bigint").alias("_s"), "_e", "_n"))
        run = Window.partitionBy(*named).orderBy("_blk", F.col("_s").asc_nulls_first())
        edge = edge.withColumn("_own", F.last("_s", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)))
        edge = edge.groupBy(*named, "_own").agg(F.max("_e").alias("_e"), F.sum("_n").alias("_n")).withColumnRenamed("_own", "_s")
        parts = whole.where("NOT _last").select(*named, "_s", "_e", "_n").unionByName(edge.select(*named, "_s", "_e", "_n"))
    return parts.select(*[F.col(n).alias(k) for n, k in zip(named, keys)], F.col("_s").alias(names[0]), F.col("_e").alias(names[1]), F.col("_n").alias("n_rows"))
