"""Analytics over timers, logs and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadica.operators.skew import FLOOR, all_of, with_blocks


def durations(events: DataFrame) -> DataFrame:
    """Each finished event once (rows sent again are equal but for when), with ``duration_us`` above 0."""
    cols = ["rank", "event", "t_start_us", "t_end_us"]
    return events.select(*cols).where("event IS NOT NULL AND t_end_us > t_start_us").distinct().withColumn("duration_us", F.col("t_end_us") - F.col("t_start_us"))


def medians(df: DataFrame, by: list[str], value: str, floor: int = FLOOR) -> DataFrame:
    """``by``, ``median``: exact medians (the mean of the two middle values) without holding a group in memory.

    Equal values are counted before the shuffle; the middle ranks are met by running counts. A group with more than
    ``floor`` distinct values is cut into blocks by value, each counted apart. Null values are left out; a null in ``by`` is
    a group like others.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts, hot = with_blocks(counts, by, "_v", floor=floor, counted=df.select(*by))
    unit = [*by, "_blk"] if hot else by
    counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*unit).orderBy("_v")))
    if hot:
        sizes = counts.groupBy(*unit).agg(F.sum("_n").alias("_s"))
        w = Window.partitionBy(*by)
        sizes = sizes.select(*unit, F.coalesce(F.sum("_s").over(w.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(w).alias("_all"))
        counts = _beside(counts, sizes, unit).withColumn("_upto", F.col("_upto") + F.col("_before"))
    else:
        counts = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    low, high = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    met = lambda k: F.max(F.when((F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k), F.col("_v")))
    return counts.groupBy(*by).agg(((met(low) + met(high)) / 2).alias("median"))


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Join on columns that may be null."""
    other = b.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[c for c in b.columns if c not in by])
    on = all_of([F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by])
    return a.join(other, on).drop(*[f"_r_{c}" for c in by])


def timer_statistics(events: DataFrame, by: list[str], floor: int = FLOOR) -> DataFrame:
    """Number, least, largest, mean, median, population deviation and total of the durations, by ``by``."""
    d = F.col("duration_us")
    sums = events.groupBy(*by).agg(F.count(d).alias("n"), F.min(d).alias("least"), F.max(d).alias("largest"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("deviation"), F.sum(d).alias("total"))
    return _beside(sums, medians(events, by, "duration_us", floor), by)


def numbered_steps(events: DataFrame) -> DataFrame:
    """``step``: the how-manieth time a rank is in an event, from 0."""
    return events.withColumn("step", F.row_number().over(Window.partitionBy("rank", "event").orderBy("t_start_us", "t_end_us")) - 1)


def imbalance(events: DataFrame, io_events: DataFrame | None = None) -> DataFrame:
    """Per event: the largest of the ranks' mean durations over the mean of these means, and the rank that has it (the lowest of equals).

    With ``io_events`` (event) only ranks that are in one of those count.
    """
    if io_events is not None:
        io = events.join(io_events.select("event").distinct(), "event", "left_semi").select("rank").distinct()
        events = events.join(io, "rank", "left_semi")
    per = events.where("rank IS NOT NULL").groupBy("event", "rank").agg(F.avg("duration_us").alias("m"))
    return per.groupBy("event").agg(F.count(F.lit(1)).alias("ranks"), (F.max("m") / F.avg("m")).alias("imbalance"), F.max_by("rank", F.struct(F.col("m"), -F.col("rank"))).alias("slowest"))


def systems_sum(*systems: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pt_id, value: the values that several systems have at the same points, of each of ``by``, added up."""
    key = [*(by or []), "pt_id"]
    out = systems[0].select(*key, "value")
    for s in systems[1:]:
        out = out.unionByName(s.select(*key, "value"))
    return out.groupBy(*key).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("systems"))


def diagnostics(lines: DataFrame, coefficients: DataFrame) -> DataFrame:
    """task_id, line_no, text of numbers -> line_no, column, value: the sum of coeff * number over the tasks."""
    words = lines.select("task_id", "line_no", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("column", "w"))
    return words.join(coefficients.select("task_id", "coeff"), "task_id").groupBy("line_no", "column").agg(F.sum(F.col("coeff") * F.expr("try_cast(w AS DOUBLE)")).alias("value"))


def error_table(logs: DataFrame, pattern: str = r"([A-Za-z][\w ]*?)\s*[:=]\s*([-+]?\d+\.?\d*(?:[eE][-+]?\d+)?)") -> DataFrame:
    """run, name, value for every ``name: number`` in log lines (run, text)."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(found[0].alias("name"), found[1].alias("value"))
    return logs.select("run", F.inline(pairs)).select("run", F.lower(F.trim("name")).alias("name"), F.expr("try_cast(value AS DOUBLE)").alias("value"))


def sampling_variance(samples: DataFrame) -> DataFrame:
    """Per sample size: the mean and population variance, over repeats, of each repeat's mean (size, repeat, value)."""
    means = samples.groupBy("size", "repeat").agg(F.avg("value").alias("m"))
    return means.groupBy("size").agg(F.count(F.lit(1)).alias("repeats"), F.avg("m").alias("mean"), F.var_pop("m").alias("variance"))


def surplus_correlations(table: DataFrame) -> DataFrame:
    """Correlations of level sum, least, largest and largest size of the surpluses (level_sum, least, largest)."""
    t = table.withColumn("delta", F.greatest(F.abs("least"), F.abs("largest")))
    names = ["level_sum", "least", "largest", "delta"]
    cells: list[Column] = [F.corr(a, b).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    return t.agg(*cells)


def transfer_statistics(transfers: DataFrame) -> DataFrame:
    """Per kind of transfer: number, bytes and seconds, and the mean rate (kind, bytes, seconds)."""
    return transfers.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"), (F.sum("bytes") / F.nullif(F.sum("seconds"), F.lit(0.0))).alias("rate"))


def errors_between(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Mean, root mean square and largest difference, absolute and relative to ``b``."""
    j = a.select(*key, F.col("value").alias("a")).join(b.select(*key, F.col("value").alias("b")), key)
    d, e = F.abs(F.col("a") - F.col("b")), F.abs("b")
    s = j.agg(F.avg(d).alias("l1"), F.sqrt(F.avg(d * d)).alias("l2"), F.max(d).alias("linf"), F.avg(e).alias("e1"), F.sqrt(F.avg(e * e)).alias("e2"), F.max(e).alias("einf"))
    return s.select("l1", "l2", "linf", *[F.when(F.col(f"e{x}") != 0, F.col(f"l{x}") / F.col(f"e{x}")).alias(f"rel_{x}") for x in ("1", "2", "inf")])
