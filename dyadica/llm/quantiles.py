"""Percentiles per group of very large integer columns, within a stated error, mergeable by day.

Values are summarised as counts of buckets whose width grows with the value: 512 to an octave, so
that a bucket's middle is within 1/1024 of every value in it, and values under 1024 are exact. The
counts of any days, partitions or files are joined by adding them, and the percentiles of the
joined summaries are those of all rows at once.

The percentiles are found by a multi-select over the summaries, which are made where the rows are. In each round every
part (a day's summary, or that of days with the same hash) proposes the median of what is still in the running for a group and a rank; the
median of the proposals, weighted by the rows behind them, becomes the pivot; all parts count
below, at and above it; and the ranges that the counts rule out are dropped. A round drops at least a quarter of
what is left, and rounds go on for each group and rank until it is found. They are a fold in the row that holds a group's parts, whose size is bounded by
the number of buckets, so no round needs a job or a shuffle. The rank of percentile ``p`` among ``n`` is
``ceil(p * n)``, the smallest value with at least that share at or below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bound of the relative error: half a bucket's width against its lower edge.
ERROR = 1 / 1024
#: The percentiles by the name of their column, per mille to keep ranks exact.
LEVELS = {"p50": 500, "p90": 900, "p95": 950, "p99": 990, "p999": 999}
#: Parts that the days of a key are dealt to: the bound of how many summaries are held against each other.
PARTS = 64
#: Rounds that suffice for any number of rows: each leaves three quarters of them at most, and 2^63 * 0.75^152 < 1.
ROUNDS = 152


def bucket(value: str) -> Column:
    """The bucket of a bigint: monotone, odd about zero, exact below 1024."""
    return F.expr(f"""CASE WHEN abs(greatest({value}, -9223372036854775807L)) < 512 THEN {value} ELSE
        sign({value}) * (((length(bin(abs(greatest({value}, -9223372036854775807L)))) - 10) * 512L)
        + shiftright(abs(greatest({value}, -9223372036854775807L)), length(bin(abs(greatest({value}, -9223372036854775807L)))) - 10)) END""").cast("bigint")


def middle(b: str) -> Column:
    """The value that stands for a bucket: its middle, rounded down in size."""
    s = f"greatest(abs({b}) div 512 - 1, 0L)"
    return F.expr(f"CASE WHEN abs({b}) < 512 THEN {b} ELSE CAST(sign({b}) AS BIGINT) * (shiftleft(abs({b}) - {s} * 512, CAST({s} AS INT)) + shiftright(shiftleft(1L, CAST({s} AS INT)), 1)) END").cast("bigint")


def readings(stats: DataFrame) -> DataFrame:
    """One row per reading with a duration, on the day of its first logging.

    A reading is a ``stat_id``; rows sent again have the same values. A row without ``stat_id`` is a
    reading of its own. A missing ``logged_at`` makes the day null, which is a day like others.
    """
    v = ["task_id", "group_no", "duration_us"]
    rows = stats.select("stat_id", *v, F.to_date("logged_at").alias("day")).where("duration_us IS NOT NULL")
    named = rows.where("stat_id IS NOT NULL").groupBy("stat_id").agg(*[F.min(c).alias(c) for c in [*v, "day"]])
    return named.select(*v, "day").unionByName(rows.where("stat_id IS NULL").select(*v, "day"))


def summaries(values: DataFrame) -> DataFrame:
    """scope, key, day, bucket, n: the mergeable counts, by ``group`` (not missing, not -1) and by ``task``.

    Counts are added up before the shuffle, so a hot group sends no more rows than it has buckets.
    """
    scopes = F.array(
        F.struct(F.lit("group").alias("scope"), F.when(F.col("group_no") != -1, F.col("group_no")).cast("bigint").alias("key")),
        F.struct(F.lit("task").alias("scope"), F.col("task_id").cast("bigint").alias("key")),
    )
    once = values.select("group_no", "task_id", "day", bucket("duration_us").alias("bucket"))
    rows = once.select(F.inline(F.filter(scopes, lambda s: s["key"].isNotNull())), "day", "bucket")
    return rows.groupBy("scope", "key", "day", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """Summaries of separate days or partitions joined to one; a reading must be in one part only."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("scope", "key", "day", "bucket").agg(F.sum("n").alias("n"))


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _count(part: str, low: str, high: str, test: str) -> str:
    """SQL: how many of a part's entries from the first on pass ``test`` of the entry numbered ``at + h - 1``, known to be from ``low`` to ``high``: a search by halves."""
    return f"aggregate({part}.h, {low}, (at, h) -> IF(at + h <= {high} AND {test}, at + h, at))"


def _selected(k: str) -> str:
    """SQL for the bucket of rank ``k`` among the summaries ``parts`` of a key, by rounds of pivots.

    The state of a search: of each part, the entries ``i`` to ``j`` that are in the running, and the bucket once it is found.
    """
    base, weight = "coalesce(get(x.c, y.i - 1), 0L)", "get(x.c, y.j - 1) - coalesce(get(x.c, y.i - 1), 0L)"
    median = _let(base, "o", _let(weight, "w", "named_struct('m', get(x.b, " + _count("x", "y.i", "y.j", "2 * (get(x.c, at + h - 1) - o) < w") + "), 'w', w)"))
    proposals = f"array_sort(filter(zip_with(parts, acc.s, (x, y) -> IF(y.i < y.j, {median}, NULL)), z -> z IS NOT NULL))"
    total = "aggregate(ms, 0L, (t, z) -> t + z.w)"
    pivot = f"aggregate(ms, named_struct('t', 0L, 'p', CAST(NULL AS BIGINT)), (q, z) -> named_struct('t', q.t + z.w, 'p', coalesce(q.p, IF(2 * (q.t + z.w) >= total, z.m, NULL)))).p"
    below, upto = _count("x", "y.i", "y.j", "get(x.b, at + h - 1) < p"), _count("x", "y.i", "y.j", "get(x.b, at + h - 1) <= p")
    cuts = f"zip_with(parts, acc.s, (x, y) -> named_struct('u', {below}, 'v', {upto}))"
    rows = lambda e: f"aggregate(zip_with(parts, cs, (x, y) -> coalesce(get(x.c, y.{e} - 1), 0L)), 0L, (t, z) -> t + z)"
    low = "named_struct('s', zip_with(acc.s, cs, (y, z) -> named_struct('i', y.i, 'j', z.u)), 'at', acc.at)"
    high = "named_struct('s', zip_with(acc.s, cs, (y, z) -> named_struct('i', z.v, 'j', y.j)), 'at', acc.at)"
    verdict = f"CASE WHEN {k} <= {rows('u')} THEN {low} WHEN {k} > {rows('v')} THEN {high} ELSE named_struct('s', acc.s, 'at', p) END"
    step = _let(proposals, "ms", _let(total, "total", _let(pivot, "p", _let(cuts, "cs", verdict))))
    start = "named_struct('s', transform(parts, x -> named_struct('i', 0, 'j', size(x.b))), 'at', CAST(NULL AS BIGINT))"
    return f"aggregate(sequence(1, least({ROUNDS}, entries)), {start}, (acc, round) -> IF(acc.at IS NOT NULL, acc, {step})).at"


def select_ranks(summary: DataFrame, levels: dict[str, int] | None = None) -> DataFrame:
    """scope, key, n and a column per level: the percentiles of all days of each key.

    An empty summary gives an empty table. One shuffle brings the summaries of a key together: ``PARTS`` of at most as many entries as there
    are buckets (28,000), however many rows or days there are.
    """
    levels = levels or LEVELS
    own = ["scope", "key", "part"]
    parts = summary.select("scope", "key", F.pmod(F.xxhash64("day"), F.lit(PARTS)).alias("part"), "bucket", "n").repartition("scope", "key")
    parts = parts.groupBy(*own, "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy(*own).orderBy("bucket")))
    parts = parts.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("bucket", "upto"))).alias("x"))
    halves = F.expr("transform(sequence(0, CAST(floor(log2(size(x))) AS INT)), e -> shiftleft(1, CAST(floor(log2(size(x))) AS INT) - e))")
    parts = parts.select("scope", "key", F.struct(F.col("x.bucket").alias("b"), F.col("x.upto").alias("c"), halves.alias("h")).alias("part"))
    keys = parts.groupBy("scope", "key").agg(F.collect_list("part").alias("parts"))
    keys = keys.selectExpr("*", "aggregate(parts, 0L, (t, x) -> t + element_at(x.c, -1)) AS n", "aggregate(parts, 0, (t, x) -> t + size(x.b)) AS entries")
    ranks = ", ".join(f"(n * {m}L + 999L) div 1000L" for m in levels.values())
    found = keys.selectExpr("scope", "key", "n", f"transform(array({ranks}), k -> {_selected('k')}) AS at")
    found = found.select("scope", "key", "n", F.inline_outer(F.array(F.struct(*[F.get("at", F.lit(i)).alias(f"_{q}") for i, q in enumerate(levels)]))))  # a generator, so that the search isn't copied into every column
    return found.select("scope", "key", "n", *[middle(f"_{q}").alias(q) for q in levels])


def percentiles(stats: DataFrame) -> DataFrame:
    """The percentiles of ``duration_us`` by group and by task, each reading once, bad ones too."""
    return select_ranks(summaries(readings(stats)))
