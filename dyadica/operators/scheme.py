"""Combination schemes: which grids are combined, with which coefficients.

A scheme is a DataFrame of ``level array<int>, coeff double``. Level sets are made by exploding
sequences, one dimension after the other, and filtered; neighbours are found by writing each level's
contribution to the levels it reaches and adding them up, not by comparing pairs.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadica.functions import levels as L
from dyadica.operators.skew import numbered

SCHEME = T.StructType([T.StructField("level", T.ArrayType(T.IntegerType(), False)), T.StructField("coeff", T.DoubleType())])


def box(spark: SparkSession, low: list[int], high: list[int]) -> DataFrame:
    """``level``: all vectors between ``low`` and ``high``. A dimension with low > high leaves nothing."""
    df = spark.range(1).select(F.array().cast("array<int>").alias("level"))
    for a, b in zip(low, high):
        if a > b:
            return df.where("false")
        df = df.select("level", F.explode(F.sequence(F.lit(a), F.lit(b))).alias("x")).select(F.concat("level", F.array("x")).alias("level"))
    return df


def box_below(level: Column, least: int = 1) -> Column:
    """The vectors from ``least`` up to ``level``, as an array of arrays (a cartesian product by a fold)."""
    start = F.array(F.array().cast("array<int>"))
    return F.aggregate(level, start, lambda acc, l: F.flatten(F.transform(acc, lambda v: F.transform(F.sequence(F.lit(least), l), lambda x: F.concat(v, F.array(x))))))


def down_set(df: DataFrame, least: int = 1) -> DataFrame:
    """All levels at or below those of ``df``, once each."""
    return df.select(F.explode(box_below(F.col("level"), least)).alias("level")).distinct()


def truncated_levels(spark: SparkSession, lmin: list[int], lmax: list[int]) -> DataFrame:
    """The truncated hierarchical levels: l <= lmax, and the excess over lmax - n sums to n at most, n the least difference."""
    n = min(b - a for a, b in zip(lmin, lmax))
    base = [b - n for b in lmax]
    excess = F.aggregate(F.transform("level", lambda l, d: F.greatest(l - F.get(L.vec(base), d), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return box(spark, [1] * len(lmax), lmax).where(excess <= n)


def classical(spark: SparkSession, lmin: list[int], lmax: list[int], fault_tolerant: bool = False) -> DataFrame:
    """The classical scheme: the top diagonals with binomial coefficients; dimensions with lmin = lmax stay fixed.

    ``fault_tolerant`` adds the two diagonals below with coefficient 0.
    """
    if not lmin or len(lmin) != len(lmax) or any(a > b for a, b in zip(lmin, lmax)):
        raise ValueError("lmin and lmax must have the same dimensions, lmin <= lmax")
    live = [d for d in range(len(lmax)) if lmax[d] > lmin[d]]
    if not live:
        return spark.createDataFrame([(list(lmin), 1.0)], SCHEME)
    c = min(lmax[d] - lmin[d] for d in live)
    low = [lmax[d] - c if d in live else lmax[d] for d in range(len(lmax))]
    eff, n = len(live), sum(low) + c
    p = F.lit(n) - L.total(F.col("level"))
    coeffs = F.create_map(*[x for q in range(eff) for x in (F.lit(q), F.lit(float((-1) ** q * math.comb(eff - 1, q))))])
    grids = box(spark, [max(1, x) for x in low], [lmax[d] for d in range(len(lmax))]).withColumn("p", p.cast("int"))
    last = eff + 2 if fault_tolerant else eff
    return grids.where((F.col("p") >= 0) & (F.col("p") < last)).select("level", F.coalesce(coeffs[F.col("p")], F.lit(0.0)).alias("coeff"))


def coefficients(df: DataFrame, dim: int) -> DataFrame:
    """Inclusion and exclusion over a set of levels: each level adds (-1)^|e| to the level e below it, e in {0,1}^dim.

    Levels whose coefficient is 0 are dropped.
    """
    steps = F.array(*[L.vec(list(e)) for e in itertools.product((0, 1), repeat=dim)])
    set_ = df.select("level").distinct()
    reach = set_.select(F.explode(F.transform(steps, lambda e: F.struct(L.sub(F.col("level"), e).alias("level"), F.when(L.total(e) % 2 == 0, 1.0).otherwise(-1.0).alias("c")))).alias("r")).select("r.*")
    return reach.groupBy("level").agg(F.sum("c").alias("coeff")).join(set_, "level", "left_semi").where("coeff != 0")


def adaptive(spark: SparkSession, lmin: list[int], lmax: list[int]) -> DataFrame:
    """The scheme over all levels up to the diagonal through the furthest corner."""
    n = max(b - a for a, b in zip(lmin, lmax))
    cand = truncated_levels(spark, [b - n for b in lmax], lmax).where(L.leq(L.vec(lmin), F.col("level")) & (L.total(F.col("level")) <= sum(lmin) + n))
    return coefficients(cand, len(lmax))


def from_rows(spark: SparkSession, rows: list[tuple[list[int], float]]) -> DataFrame:
    return spark.createDataFrame([([int(x) for x in l], float(c)) for l, c in rows], SCHEME)


def from_json(spark: SparkSession, path: str, lmin: list[int] | None = None, lmax: list[int] | None = None) -> DataFrame:
    """A scheme from a JSON array of ``{coeff, level, group_no?}``; ``task_id`` counts the entries.

    Groups must be given for all entries or for none, and levels lie between the bounds, if there are any.
    """
    schema = "coeff double, level array<int>, group_no int"
    df = spark.read.schema(schema).json(path, multiLine=True)
    bad = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("group_no").alias("g"),
        F.count(F.when(F.col("coeff").isNull() | F.col("level").isNull(), 1)).alias("missing"),
        F.count(F.when(F.lit(lmin is not None) & ~L.leq(L.vec(lmin or [0]), F.col("level")) | F.lit(lmax is not None) & ~L.leq(F.col("level"), L.vec(lmax or [0])), 1)).alias("out"),
    ).first()
    if bad["g"] not in (0, bad["n"]) or bad["missing"] or bad["out"]:
        raise ValueError(f"inconsistent scheme: {bad.asDict()}")
    return df.withColumn("task_id", F.monotonically_increasing_id())


def to_json(scheme: DataFrame, path: str) -> None:
    """The scheme as one JSON array of ``{coeff, level, group_no?}``, as :func:`from_json` reads it; a scheme is small enough for one file."""
    cols = ["level", "coeff", *(["group_no"] if "group_no" in scheme.columns else [])]
    one = scheme.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def active_down_set(scheme: DataFrame, least: int = 1) -> DataFrame:
    """The levels under the grids whose coefficient is exactly 1."""
    return down_set(scheme.where("coeff = 1"), least)


def combi_dof(scheme: DataFrame, boundary: int = 2) -> DataFrame:
    return scheme.withColumn("dof", L.dof_nodal(F.col("level"), boundary))


def sparse_dof(levels: DataFrame, boundary: int = 2) -> DataFrame:
    """One row: the number of subspaces and of points of the sparse grid."""
    return levels.agg(F.count(F.lit(1)).alias("subspaces"), F.sum(L.dof_hierarchical(F.col("level"), boundary)).alias("dof"))


def partitioned_dof(levels: DataFrame, reference: list[int], cuts: list[list[int]]) -> DataFrame:
    """Points of the sparse grid in each block of a rectilinear decomposition (boundary 2): ``part`` (column-major), ``dof``.

    ``cuts[d]`` are the first indices of the blocks of dimension d on the reference level, the first of them 0.
    """
    df = levels.select("level", F.lit(0).alias("part"), F.lit(1).cast("bigint").alias("dof"))
    step = 1
    for d, at in enumerate(cuts):
        l, ref = F.get("level", F.lit(d)), F.lit(reference[d])
        upto = [F.lit(-1).cast("bigint"), *[L.highest_below(l, F.lit(x).cast("bigint"), ref) for x in at[1:]], L.hierarchical_1d(l, 2) - 1]
        counts = F.array(*[F.struct(F.lit(k).alias("k"), (upto[k + 1] - upto[k]).alias("n")) for k in range(len(at))])
        df = df.select("level", "part", "dof", F.inline(counts)).select("level", (F.col("part") + F.col("k") * step).alias("part"), (F.col("dof") * F.col("n")).alias("dof"))
        step *= len(at)
    return df.groupBy("part").agg(F.sum("dof").alias("dof"))


def conjoint_set(scheme: DataFrame, lmin: list[int]) -> DataFrame:
    """Subspaces that must be shared with another system: seen from fewer than ``dim`` downward poles of the active front, closed downward."""
    dim = len(lmin)

    def pole(d: int) -> Column:
        own, least = F.get("level", F.lit(d)), F.lit(lmin[d])
        moved = lambda x: F.transform("level", lambda l, j: F.when(j == d, x).otherwise(l))
        return F.when(own > least, F.transform(F.sequence(least, F.greatest(own - 1, least)), moved)).otherwise(F.array().cast("array<array<int>>"))

    poles = F.flatten(F.array(*[pole(d) for d in range(dim)]))
    seen = scheme.where(F.abs(F.col("coeff") - 1) < 1e-9).select(F.explode(poles).alias("level")).groupBy("level").count()
    return down_set(seen.where(F.col("count") < dim))


def k_subsets(k: int, d: int) -> list[tuple[int, ...]]:
    """The subsets of k out of d dimensions."""
    return list(itertools.combinations(range(d), k))


def of_group(scheme: DataFrame, group: int) -> DataFrame:
    return scheme.where(F.col("group_no") == group)


def round_robin(scheme: DataFrame, groups: int) -> DataFrame:
    """``group`` by turns, in the order of ``task_id``; ids must count from 0."""
    return scheme.withColumn("group", (F.col("task_id") % groups).cast("int"))


def load_balanced(scheme: DataFrame, groups: int, limit: int = 1_000_000) -> DataFrame:
    """``group`` by the greedy rule: the largest grid next to the least loaded group, the lowest number if tied; equal grids by ``task_id``.

    The rule is sequential, so it runs on the driver; a scheme of more than ``limit`` grids is refused.
    """
    import heapq

    rows = combi_dof(scheme).select("task_id", "dof").orderBy(F.desc("dof"), "task_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} grids")
    heap, out = [(0, g) for g in range(groups)], []
    for r in rows:
        load, g = heapq.heappop(heap)
        out.append((r["task_id"], g, load + r["dof"]))
        heapq.heappush(heap, (load + r["dof"], g))
    plan = scheme.sparkSession.createDataFrame([x[:2] for x in out], "task_id bigint, group int")
    return scheme.join(plan, "task_id")


def split(scheme: DataFrame, fractions: list[float], order: str = "task_id") -> DataFrame:
    """``system`` by consecutive fractions of the ordered scheme: grid k belongs to the first system with k < round(n * cumulated fraction)."""
    if abs(sum(fractions) - 1) > 1e-3:
        raise ValueError("the fractions must add up to 1")
    n = scheme.count()
    ends = [math.floor(n * sum(fractions[: i + 1]) + 0.5) for i in range(len(fractions))]
    which = F.lit(len(ends) - 1)
    for i in range(len(ends) - 1, -1, -1):
        which = F.when(F.col("_k") < ends[i], i).otherwise(which)
    return numbered(scheme, [order], "_k").withColumn("system", which.cast("int")).drop("_k")


# Active sets: the front grids that a scheme is spanned by. They are small and made on the driver.


def diagonal_set(lmin: list[int], lmax: list[int], shift: int = 0) -> set[tuple[int, ...]]:
    """The levels on the diagonal through the furthest corner, moved by ``shift``."""
    n = sum(lmin) + max(b - a for a, b in zip(lmin, lmax)) + shift
    return {l for l in itertools.product(*[range(a, b + 1) for a, b in zip(lmin, lmax)]) if sum(l) == n}


def extra_diagonals(lmin: list[int], lmax: list[int], count: int = 2) -> set[tuple[int, ...]]:
    """The diagonals below those that a scheme needs, for use after faults."""
    live = [d for d in range(len(lmin)) if lmax[d] != lmin[d]]
    top = max(lmax[d] for d in live) - max(lmin[d] for d in live) + sum(lmin)
    sums = {top - q for q in range(len(live), len(live) + count)}
    return {l for l in itertools.product(*[range(max(1, a), b + 1) for a, b in zip(lmin, lmax)]) if sum(l) in sums}


def root_set(lmin: list[int], lmax: list[int]) -> set[tuple[int, ...]]:
    """The minimum and, in each dimension, the minimum with that dimension at its maximum."""
    return {tuple(lmin)} | {tuple(lmax[d] if d == e else lmin[d] for d in range(len(lmin))) for e in range(len(lmin))}


def tilted_plane_set(normal: list[float], anchor: list[float]) -> set[tuple[int, ...]]:
    """The levels just below a plane, seen along each axis."""
    dim = len(normal)

    def height(axis: int, others: dict[int, float]) -> float:
        return sum((anchor[j] - x) * normal[j] for j, x in others.items()) / normal[axis] + anchor[axis]

    # where the plane meets an axis that starts at level 1
    top = [math.ceil(height(d, {j: 1.0 for j in range(dim) if j != d})) for d in range(dim)]
    out = set()
    for d in range(dim):
        rest = [j for j in range(dim) if j != d]
        for combo in itertools.product(*[range(1, top[j] + 1) for j in rest]):
            point = [0.0] * dim
            for j, x in zip(rest, combo):
                point[j] = x
            point[d] = height(d, dict(zip(rest, combo)))
            if min(point) >= 1:
                out.add(tuple(math.floor(x) for x in point))
    return out


def thinned_set(lmin: list[int], lmax: list[int], drop: int, seed: int = 0) -> set[tuple[int, ...]]:
    """The diagonal without ``drop`` of its grids, chosen at random so that every dimension still reaches its maximum."""
    import random

    full = sorted(diagonal_set(lmin, lmax))
    reach = [max(l[d] for l in full) for d in range(len(lmax))]
    if drop > len(full) - len(lmax):
        raise ValueError("more grids dropped than the diagonal can spare")
    rng = random.Random(seed)
    while True:
        kept = rng.sample(full, len(full) - drop)
        if [max(l[d] for l in kept) for d in range(len(lmax))] == reach:
            return set(kept)


def spanned(spark: SparkSession, active: set[tuple[int, ...]]) -> DataFrame:
    """The scheme that an active set spans: inclusion and exclusion over the levels under it."""
    dim = len(next(iter(active)))
    front = spark.createDataFrame([(list(a), 1.0) for a in sorted(active)], SCHEME)
    return coefficients(down_set(front, 0), dim)


def nearest_neighbours(levels: list[tuple[int, ...]], k: int = 1) -> dict[tuple[int, ...], list[tuple[int, ...]]]:
    """The k nearest other levels of each, by the sum of differences; ties in lexicographic order."""
    return {a: sorted((b for b in levels if b != a), key=lambda b: (sum(abs(x - y) for x, y in zip(a, b)), b))[:k] for a in levels}


def hierarchical_weights(scheme: DataFrame, by: list[str] | None = None) -> DataFrame:
    """w of each level under the scheme, or each of the schemes told apart by ``by``: the sum of the coefficients of the grids at or above it."""
    return scheme.select(*(by or []), F.explode(box_below(F.col("level"))).alias("sub"), "coeff").groupBy(*(by or []), "sub").agg(F.sum("coeff").alias("w")).withColumnRenamed("sub", "level")


def objective(weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of 4^-|l| * w."""
    return weights.groupBy(*(by or [])).agg(F.sum(F.pow(F.lit(4.0), -L.total(F.col("level"))) * F.col("w")).alias("q"))


def assigned_by_size(scheme: DataFrame, groups: int) -> DataFrame:
    """``group`` by turns through the grids in the order of their level sums."""
    order = [L.total(F.col("level")), *(["task_id"] if "task_id" in scheme.columns else []), "level"]
    return numbered(scheme, order, "_k").withColumn("group", (F.col("_k") % groups).cast("int")).drop("_k")
