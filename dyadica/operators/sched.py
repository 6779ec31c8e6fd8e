"""Load models and the assignment of grids to groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadica.functions import levels as L
from dyadica.operators.skew import numbered


def linear_load(level: Column) -> Column:
    """The number of points up to a constant: prod 2^l."""
    return F.pow(F.lit(2.0), L.total(level))


# Fixed values of the published load model: seconds = (SCALE * points^POWER + OFFSET) * h, where h is a polynomial of second degree in
# the shares x, y, z that dimensions 0, 2 and 3 have in the level sum.
SCALE, POWER, OFFSET = 1.252e-05, 1.076, 0.01308
CONSTANT = 2.6451
LINEAR = {"x": -10.7883, "y": -0.8959, "z": -0.4814}
QUADRATIC = {"xx": 15.3450, "xy": 1.0204, "xz": 2.9396, "yy": 2.3668, "yz": -1.1119, "zz": 0.3434}


def anisotropy_load(level: Column) -> Column:
    """Seconds by the load model with anisotropy; null for levels of fewer than four dimensions."""
    size = L.total(level).cast("double")
    share = {name: F.get(level, F.lit(d)) / size for name, d in (("x", 0), ("y", 2), ("z", 3))}
    h = F.lit(CONSTANT)
    for name, c in LINEAR.items():
        h = h + c * share[name]
    for pair, c in QUADRATIC.items():
        h = h + c * share[pair[0]] * share[pair[1]]
    return F.when(size > 0, (SCALE * F.pow(linear_load(level), F.lit(POWER)) + OFFSET) * h)


#: Durations beyond which no step can have taken, in microseconds (ten years): no part of a history.
LONGEST = 315_576_000_000_000


def last_n(stats: DataFrame, n: int, scheme: DataFrame | None = None, longest: int = LONGEST) -> DataFrame:
    """task_id, load, readings: the mean of the last ``n`` durations from 1 to ``longest`` of each task, by simulated time.

    Repeated readings count once. With ``scheme`` every task appears: one without history has the linear load and 0
    readings. Ties of time are broken by ``stat_id``. A hot task keeps only its last n rows in each task before the shuffle
    (a group limit that Spark derives from the rank filter).
    """
    once = stats.where("task_id IS NOT NULL AND sim_time IS NOT NULL AND NOT isnan(sim_time)").where(F.col("duration_us").between(1, longest)).groupBy("task_id", "stat_id").agg(F.min("duration_us").alias("duration_us"), F.min("sim_time").alias("sim_time"))
    w = Window.partitionBy("task_id").orderBy(F.desc("sim_time"), F.desc("stat_id"))
    mean = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("task_id").agg(F.avg("duration_us").alias("load"), F.count(F.lit(1)).alias("readings"))
    if scheme is None:
        return mean
    from dyadica.operators.grids import tasks_of

    return tasks_of(scheme).join(mean, "task_id", "left").select("task_id", F.coalesce("load", linear_load(F.col("level"))).alias("load"), F.coalesce("readings", F.lit(0)).alias("readings"))


def averages(stats: DataFrame, longest: int = LONGEST) -> DataFrame:
    """task_id, load, readings: the mean of all durations from 1 to ``longest``, each reading once."""
    once = stats.where("task_id IS NOT NULL").where(F.col("duration_us").between(1, longest)).groupBy("task_id", "stat_id").agg(F.min("duration_us").alias("duration_us"))
    return once.groupBy("task_id").agg(F.avg("duration_us").alias("load"), F.count(F.lit(1)).alias("readings"))


def dispatch_order(loads: DataFrame) -> DataFrame:
    """The order in which tasks are handed to free groups: heaviest first, ties by id."""
    return numbered(loads, [F.desc("load"), "task_id"], "place", 1)


def rebalance(tasks: Sequence[tuple[int, int, float]], rounds: int = 10, threshold: float = 1.1, as_before: bool = False) -> list[tuple[int, int, int]]:
    """Moves (task, from group, to group) that even out the loads of groups; ``tasks`` are (task, group, load).

    In each round that task of the slowest group moves to the fastest group which brings the latter closest to the mean load, unless that
    makes it as slow; it ends when the slowest group's load is less than ``threshold`` times the mean. A task is listed once, from where it was to where it
    is in the end, and not at all if it came back. ``as_before`` does as older plans did: the mean is per task instead of per group, the imbalance drops its fraction, and
    a task that has moved counts as where it went first, while the list has where it went last. Ties go to the lowest number. The rule is
    sequential and runs over a scheme's tasks alone, on the driver: a million at most.
    """
    origin = {t: g for t, g, _ in tasks}
    group, to = dict(origin), {}
    load = {t: float(x) for t, _, x in tasks}
    if not tasks:
        return []
    mean = sum(load.values()) / (len(tasks) if as_before else len(set(group.values())))
    for _ in range(rounds if mean > 0 else 0):
        total = dict.fromkeys(sorted(set(group.values())), 0.0)
        for t, g in group.items():
            total[g] += load[t]
        slow, fast = max(total, key=total.get), min(total, key=total.get)
        excess = total[slow] / mean
        if (int(excess) if as_before else excess) < threshold:
            break
        task = min((t for t, g in group.items() if g == slow), key=lambda t: (abs(total[fast] + load[t] - mean), t))
        if total[fast] + load[task] >= total[slow]:
            break
        if not as_before or task not in to:
            group[task] = fast
        to[task] = fast
    return [(t, origin[t], g) for t, g in to.items() if as_before or g != origin[t]]


def static_moves(tasks: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, int]]:
    """The rescheduler that never moves a task."""
    return []


def moved(scheme: DataFrame, moves: Sequence[tuple[int, int, int]]) -> DataFrame:
    """The scheme with the groups after the moves, of several of one task the last; its grids are filled again from the sparse grid."""
    if not moves:
        return scheme
    m = scheme.sparkSession.createDataFrame(list({t: b for t, _, b in moves}.items()), "_task bigint, _to int")
    return scheme.join(m, F.col("task_id") == F.col("_task"), "left").withColumn("group_no", F.coalesce("_to", "group_no")).drop("_task", "_to")
