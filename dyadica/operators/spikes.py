"""Implausible readings of many sources: impossible values, spikes and stuck values.

Normal behaviour of a source is what its readings have in common from one profile to the next:
the series (logarithms, since scatter is in proportion) is laid out as a matrix whose rows are
profiles of successive readings, and robust principal components split that matrix into a
low-rank part (level, course and shape of the profile) and a sparse part (spikes). Each reading
is held against the low-rank part twice: in the profiles that end about it and in those that begin
about it. A spike lies beyond both; a lasting change of level agrees with one of them. What is chance is
told by the scatter of the residuals from the low-rank part over the whole source. Impossible values are found
by ranges, and stuck values by runs, apart from the matrix; neither is in it.

A source is worked on in stretches of ``STRETCH`` readings by their number in its order, with ``OVERLAP`` more on either
side. So memory is bounded, and nothing depends on how rows come in batches, blocks or partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadica.operators.skew import FLOOR, hot_keys, lookup_join, with_blocks
from dyadica.session import stored


@dataclass(frozen=True)
class SpikeRules:
    """profile: readings in a profile (a row of the matrix). rank: components kept.
    candidate: multiples of the scatter from which the split puts an entry aside.
    confirm: multiples of the scatter from which a residual, on both sides, is a spike; a normal
    reading, its scatter estimated from some sixty, goes beyond 6.7 less than once in a million.
    run: equal successive readings that count as stuck.
    longest_us, latest: bounds of any conceivable duration (ten years) and simulated time."""

    profile: int = 12
    rank: int = 2
    candidate: float = 4.0
    confirm: float = 6.7
    run: int = 5
    longest_us: int = 315_576_000_000_000
    latest: float = 1e9


#: Readings of a source that share their components, and readings on either side that are looked at with them.
STRETCH, OVERLAP = 1 << 13, 1 << 9
#: Steps to an octave in which the residuals are counted for their median.
STEPS = 32


def _middle(a: np.ndarray) -> float:
    k = a.size // 2
    return np.partition(a, k, axis=None)[k]


def _row_middle(a: np.ndarray) -> np.ndarray:
    s, k = np.sort(a, axis=1), a.shape[1]
    return (s[:, (k - 1) // 2] + s[:, k // 2]) / 2


def robust_components(m: np.ndarray, rank: int, candidate: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split ``m`` into a low-rank part and a sparse part by alternating projections.

    The sparse part takes the entries farther from the low-rank part than ``candidate`` times the
    residuals' scatter; the low-rank part is the best of ``rank`` to what remains, from the
    eigenvectors of the small Gram matrix. Starts from the rows' medians, which spikes can't move. Returns the low-rank part,
    which entries are in the sparse part, and each column's share in its own prediction.
    """
    k = m.shape[1] // 2
    low = np.repeat(np.partition(m, k, axis=1)[:, k : k + 1], m.shape[1], axis=1)
    kept, moved, share = None, np.inf, np.zeros(m.shape[1])
    for _ in range(rounds):
        r = np.abs(m - low)
        scale = 1.4826 * _middle(r) + 1e-12
        out = r > candidate * scale
        if kept is not None and moved < 0.1 * scale and (out == kept).all():
            break
        kept = out
        filled = np.where(out, low, m)
        mean = filled.mean(axis=0)
        c = filled - mean
        vec = np.linalg.eigh(c.T @ c)[1][:, -rank:]
        new = c @ vec @ vec.T + mean
        moved, low, share = np.abs(new - low).max(), new, (vec**2).sum(axis=1)
    return low, kept, share


def residuals(y: np.ndarray, rules: SpikeRules = SpikeRules()) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of each reading of ``y`` from the low-rank part of the profiles that end about it, and of those that begin about it.

    Those profiles are meant that have the reading in their last third, or in their first; where the series has none such, the first or the last of
    all that hold it. An entry that is not put aside had a share in its prediction; its residual is the one it would have without. A run of a third of a profile or more that lies aside from the start, or up to the end, is a change
    of level. Under six readings there are no profiles; the median takes their place.
    """
    n = len(y)
    w = min(rules.profile, n // 2)
    if w < 3:
        r = y - np.median(y) if n else y
        return r, r
    win = np.lib.stride_tricks.sliding_window_view(y, w)
    low, out, share = robust_components(win, rules.rank if w > 2 * rules.rank else 1, rules.candidate)
    r = win - low
    r = np.where(out, r, r / np.maximum(1 - share, 0.2))
    third = max(1, w // 3)
    i, k = np.arange(n)[:, None], np.arange(third)
    first, last = np.maximum(i - w + 1, 0), np.minimum(i, len(win) - 1)
    a, b = np.minimum(first + k, np.clip(i - w + third, first, last)), np.maximum(last - k, np.clip(i - third + 1, first, last))
    left, right = _row_middle(r[a, i - a]), _row_middle(r[b, i - b])
    beyond = 1.4826 * rules.candidate * _middle(np.abs(left + right) / 2)
    for sign in (1, -1):
        far = (sign * left > beyond) & (sign * right > beyond)
        head = n if far.all() else int(np.argmin(far))
        tail = n if far.all() else int(np.argmin(far[::-1]))
        for edge, at in ((head, slice(0, head)), (tail, slice(n - tail, n))):
            if edge >= third:
                left[at] = right[at] = 0.0
    return left, right


def _last_known(x: np.ndarray) -> np.ndarray:
    """nan replaced by the value before it, or, at the start, by the first there is; -1 if there is none."""
    has = np.flatnonzero(~np.isnan(x))
    if not len(has):
        return np.full(len(x), -1.0)
    at = np.searchsorted(has, np.arange(len(x)), "right") - 1
    return x[has[np.maximum(at, 0)]]


def judged(duration: np.ndarray, setting: np.ndarray, rules: SpikeRules = SpikeRules()) -> tuple[np.ndarray, np.ndarray]:
    """``far`` and ``residual`` of each of the positive ``duration`` readings of one source, in order, in logarithms.

    ``far`` is the smaller residual of the two sides, 0 if their signs differ; ``residual`` is the mean of both. ``setting`` is a condition that moves the level (a process count): each has profiles of its own.
    Where it is missing, either neighbouring setting may hold, and the smaller ``far`` counts.
    """
    n = len(duration)
    y = np.log(duration)
    before, after = _last_known(setting), _last_known(setting[::-1])[::-1]
    far, residual = np.full(n, np.inf), np.zeros(n)
    for side in (before, after):
        for v in np.unique(side):
            at = np.flatnonzero(side == v)
            part = y[at]
            left, right = residuals(part - part[len(part) // 2], rules)
            d = np.where(np.sign(left) == np.sign(right), np.sign(left) * np.minimum(np.abs(left), np.abs(right)), 0.0)
            near = np.abs(d) < np.abs(far[at])
            far[at], residual[at] = np.where(near, d, far[at]), np.where(near, (left + right) / 2, residual[at])
        if (before == after).all():
            break
    return far, residual


def spikes_of(duration: np.ndarray, setting: np.ndarray, rules: SpikeRules = SpikeRules()) -> np.ndarray:
    """Which readings of a source that is one stretch are spikes: the operator's rule without Spark. Fewer than five can't show one."""
    if len(duration) < 5:
        return np.zeros(len(duration), bool)
    far, residual = judged(duration, setting, rules)
    tick = np.gcd.reduce(duration.astype(np.int64)) / (duration * np.exp(-residual))
    return np.abs(far) > rules.confirm * (np.sqrt((1.4826 * np.median(np.abs(residual))) ** 2 + tick**2 / 12) + 1e-9)


def _same(k: int, unit: str, order: str) -> Column:
    """Whether a usable value equals the ``k``-th usable one before it."""
    return F.coalesce(F.expr(f"_u = lag(_u, {k}) IGNORE NULLS OVER (PARTITION BY {unit} ORDER BY {order})"), F.lit(False))


def _stuck(df: DataFrame, unit: str, order: str, run: int) -> DataFrame:
    """Adds ``stuck``: in a run of ``run`` or more equal successive values ``_u`` of a unit, nulls passed over."""
    back = sum((_same(k, unit, order).cast("int") for k in range(1, run)), F.lit(0)) == run - 1
    ends = df.withColumn("_e", F.when(F.col("_u").isNotNull(), back))  # the last of `run` equal ones
    ahead = [F.expr(f"lead(_e, {k}) IGNORE NULLS OVER (PARTITION BY {unit} ORDER BY {order})") for k in range(1, run)]
    hit = F.coalesce(F.col("_e"), F.lit(False))
    for a in ahead:
        hit = hit | F.coalesce(a, F.lit(False))
    return ends.withColumn("stuck", F.col("_u").isNotNull() & hit).drop("_e")


def _offsets(df: DataFrame, what: Column, name: str) -> DataFrame:
    """src, _blk and ``name``: the rows of the blocks before, of those that ``what`` holds for."""
    per = df.groupBy("src", "_blk").agg(F.count(F.when(what, 1)).alias("_c"))
    before = Window.partitionBy("src").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("src", "_blk", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias(name))


def _ordered(named: DataFrame, hot: list, rules: SpikeRules, floor: int) -> DataFrame:
    """The readings with ``stuck`` and ``r``: the number, in the order of its source, of each valid reading that is not stuck."""
    by_id = Window.partitionBy("src", *(["_ib"] if hot else [])).orderBy("id")
    before = F.last("st", ignorenulls=True).over(by_id.rowsBetween(Window.unboundedPreceding, 0))
    valid, usable = F.col("v").between(1, rules.longest_us), F.col("st").isNotNull() & ~F.col("bad") & F.col("v").isNotNull()
    count = F.when(valid & ~F.col("stuck"), 1)
    if not hot:
        # for the rows before the first stage; one frame for all rows, since one that starts at each row takes quadratic time
        after = F.first("st", ignorenulls=True).over(by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        placed = named.withColumn("place", F.coalesce(before, after, F.lit(0.0))).withColumn("_u", F.when(usable, F.col("v")))
        found = _stuck(placed, "src", "place, id", rules.run)
        return found.withColumn("r", F.count(count).over(Window.partitionBy("src").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    # the last stage of all earlier blocks, and the first of the source
    of = named.groupBy("src", "_ib").agg(F.max_by("st", F.when(F.col("st").isNotNull(), F.col("id"))).alias("_l"), F.min_by("st", F.when(F.col("st").isNotNull(), F.col("id"))).alias("_f"))
    w = Window.partitionBy("src").orderBy("_ib")
    of = of.select("src", "_ib", F.last("_l", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_l"), F.first("_f", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_f"))
    placed = named.withColumn("_b", before).join(of, ["src", "_ib"]).withColumn("place", F.coalesce("_b", "_l", "_f", F.lit(0.0))).drop("_b", "_l", "_f", "_ib")
    placed = stored(with_blocks(stored(placed), ["src"], "place", floor=floor, hot=hot)[0]).withColumn("_u", F.when(usable, F.col("v")))
    # runs inside the blocks, and runs across their limits among what lies about these
    unit = Window.partitionBy("src", "_blk")
    about = placed.where("_u IS NOT NULL").withColumn("_a", F.row_number().over(unit.orderBy("place", "id"))).withColumn("_z", F.row_number().over(unit.orderBy(F.desc("place"), F.desc("id"))))
    about = about.where((F.col("_a") < 2 * rules.run) | (F.col("_z") < 2 * rules.run)).join(_offsets(placed, F.col("_u").isNotNull(), "_o"), ["src", "_blk"])
    about = about.withColumn("_n", F.col("_o") + F.col("_a")).withColumn("_part", F.sum(F.expr("int(coalesce(_n - lag(_n) OVER (PARTITION BY src ORDER BY _n) > 1, false))")).over(Window.partitionBy("src").orderBy("_n")))
    across = _stuck(about.select("src", "_part", "id", "place", "_u"), "src, _part", "place, id", rules.run).where("stuck").select("src", "id", F.lit(True).alias("_x"))
    found = _stuck(placed, "src, _blk", "place, id", rules.run)
    found = stored(found.join(across, ["src", "id"], "left").withColumn("stuck", F.col("stuck") | F.coalesce("_x", F.lit(False))).drop("_x"))
    own = F.count(count).over(unit.orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return found.withColumn("r", own).join(_offsets(found, valid & ~F.col("stuck"), "_o"), ["src", "_blk"]).withColumn("r", F.col("r") + F.col("_o")).drop("_o")


JUDGED = ["id", "src", "v", "bad", "stuck", "far", "residual", "tick"]


def implausible(df: DataFrame, rules: SpikeRules = SpikeRules(), *, source: str = "task_id", reading: str = "stat_id", value: str = "duration_us", stage: str = "sim_time", setting: str = "n_procs", floor: int = FLOOR) -> DataFrame:
    """One row per implausible reading: ``reading`` and the flags ``impossible``, ``spike``, ``stuck``.

    Rows with equal ``reading`` are one; rows without it can't be named and are left out. A missing
    value or stage is no case; a reading without a stage is placed after the last one before it, by number, that
    has one. A reading without a source is tested for its range alone. Not-a-number and infinite
    stages are impossible. Ties of the stage are ordered by ``reading``. A stuck reading is not tested for being a spike too. A source
    with fewer than five readings that are neither impossible nor stuck has no spikes. Other columns are ignored.

    A source with more than ``floor`` rows (see ``skew``) is ordered in blocks; its stretches are those of any other source. What the components say of
    each reading is written once, and read for the scatter of each source and for the verdict.
    """
    one = (
        df.select(F.col(reading).cast("bigint").alias("id"), F.col(source).cast("bigint").alias("src"), F.col(value).cast("bigint").alias("v"), F.col(stage).cast("double").alias("st"), F.col(setting).cast("double").alias("se"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(*[F.min(c).alias(c) for c in ("src", "v", "st", "se")])
    )
    v_bad = (F.col("v") <= 0) | (F.col("v") > rules.longest_us)
    st_bad = F.isnan("st") | (F.col("st") <= 0) | (F.col("st") > rules.latest)
    one = one.withColumn("bad", F.coalesce(v_bad, F.lit(False)) | F.coalesce(st_bad, F.lit(False)))
    one = one.withColumn("st", F.when(~F.coalesce(st_bad, F.lit(True)), F.col("st")))
    hot = hot_keys(df.select(F.col(source).cast("bigint").alias("src")), ["src"], floor)
    named = one.where("src IS NOT NULL")
    rows = _ordered(with_blocks(named, ["src"], "id", "_ib", floor, hot=hot)[0], hot, rules, floor)
    # each stretch has the readings next to it as well; what is in no series but flagged goes along
    mine, at = (F.col("r") / STRETCH).cast("bigint"), F.col("r") % STRETCH
    to = F.filter(F.array(mine, F.when((at < OVERLAP) & (mine > 0), mine - 1), F.when(at >= STRETCH - OVERLAP, mine + 1)), lambda x: x.isNotNull())
    valid = F.col("v").between(1, rules.longest_us) & ~F.col("stuck")
    aside = F.when(F.col("bad") | F.col("stuck"), F.array(-1 - F.pmod("id", F.lit(1024)))).otherwise(F.array().cast("array<bigint>"))
    spread = rows.select("id", "src", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("se", F.lit(float("nan"))).alias("se"), "bad", "stuck", "r", F.explode(F.when(valid, to).otherwise(aside)).alias("stretch"))
    spread = (spread.repartition("src", "stretch") if hot else spread).sortWithinPartitions("src", "stretch", "r")

    def of(c: dict[str, np.ndarray], out: list[dict[str, np.ndarray]]) -> None:
        """The readings of one stretch."""
        own = c["r"] // STRETCH == c["stretch"][0]
        far, residual = judged(c["v"].astype(float), c["se"], rules)
        tick = np.full(len(own), np.gcd.reduce(c["v"][own]) if own.any() else 0)
        out.append({k: x[own] for k, x in {**c, "far": far, "residual": residual, "tick": tick}.items() if k in JUDGED})

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Stretches come one after the other; what a batch ends with waits for the next, for it may go on."""
        rest: dict[str, np.ndarray] | None = None
        for b in batches:
            out: list[dict[str, np.ndarray]] = []
            c = {k: b[k].to_numpy() for k in b.columns}
            apart = c["stretch"] < 0
            if apart.any():
                n = int(apart.sum())
                out.append({k: c[k][apart] for k in JUDGED[:5]} | {"far": np.zeros(n), "residual": np.full(n, np.nan), "tick": np.zeros(n, np.int64)})
                c = {k: x[~apart] for k, x in c.items()}
            if rest is not None:
                c = {k: np.concatenate([rest[k], x]) for k, x in c.items()}
            begin = 0
            for end in np.flatnonzero((np.diff(c["src"]) != 0) | (np.diff(c["stretch"]) != 0)) + 1:
                of({k: x[begin:end] for k, x in c.items()}, out)
                begin = end
            rest = {k: x[begin:] for k, x in c.items()}
            if out:
                yield pd.DataFrame({k: np.concatenate([o[k] for o in out]) for k in JUDGED})
        if rest is not None and len(rest["r"]):
            out = []
            of(rest, out)
            yield pd.DataFrame({k: out[0][k] for k in JUDGED})

    kept = stored(spread.mapInPandas(kernel, "id bigint, src bigint, v bigint, bad boolean, stuck boolean, far double, residual double, tick bigint"))
    # the median of the residuals, which are counted in steps: the same whatever the order of adding up
    inside = kept.where("NOT isnan(residual)")
    steps = F.round(F.log2(F.abs("residual") + 1e-12) * STEPS).cast("int")
    scale = inside.groupBy("src").agg(F.percentile(steps, F.lit(0.5)).alias("_m"), F.min("tick").alias("_tick"), F.count(F.lit(1)).alias("_n"))
    scale = scale.where("_n >= 5").select("src", (1.4826 * F.pow(F.lit(2.0), F.col("_m") / STEPS)).alias("_scatter"), "_tick")
    near = lookup_join(kept.where("bad OR stuck OR far != 0"), scale, ["src"], hot=hot)
    tick = F.col("_tick") / (F.col("v") * F.exp(-F.col("residual")))
    spike = F.abs("far") > rules.confirm * (F.sqrt(F.col("_scatter") * F.col("_scatter") + tick * tick / 12) + 1e-9)
    found = near.select("id", F.col("bad").alias("impossible"), F.coalesce(spike & ~F.isnan("residual"), F.lit(False)).alias("spike"), "stuck").where("impossible OR spike OR stuck")
    alone = one.where("src IS NULL AND bad").select("id", F.col("bad").alias("impossible"), F.lit(False).alias("spike"), F.lit(False).alias("stuck"))
    return found.unionByName(alone).withColumnRenamed("id", reading)
