"""Full grids as tables: ``task_id, field_id, idx array<bigint>, value``, a row per point.

Operators that need the refinement take the points joined to the scheme (:func:`with_levels`).
Null and not-a-number values are points without a value; repeated rows are one point (:func:`clean`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadica.functions import levels as L

POINT = ["task_id", "field_id", "idx"]


def clean(points: DataFrame) -> DataFrame:
    """Each point once; where repeated rows differ the largest value holds. Rows without task or index are dropped."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return points.where("task_id IS NOT NULL AND idx IS NOT NULL").groupBy(*POINT).agg(F.max(value).alias("value"))


def tasks_of(scheme: DataFrame) -> DataFrame:
    """task_id, level: each task once."""
    return scheme.where("task_id IS NOT NULL AND level IS NOT NULL").groupBy("task_id").agg(F.min("level").alias("level"))


def with_levels(points: DataFrame, scheme: DataFrame) -> DataFrame:
    """The points with their task's ``level``; points of unknown tasks, or whose index has another dimension, are dropped."""
    return points.join(tasks_of(scheme), "task_id").where(F.size("idx") == F.size("level"))


def indices(levels: DataFrame, dim: int, boundary: int = 2) -> DataFrame:
    """All points of the grids of ``levels`` (with a ``level`` of ``dim`` dimensions): adds ``idx``."""
    df = levels.withColumn("idx", F.array().cast("array<bigint>"))
    for d in range(dim):
        n = L.points_1d(F.get("level", F.lit(d)), boundary)
        df = df.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).withColumn("idx", F.concat("idx", F.array("_i"))).drop("_i")
    return df


def filled(levels: DataFrame, dim: int, function: Callable[[list[Column]], Column], boundary: int = 2) -> DataFrame:
    """Grids with values of ``function``, which takes a column per coordinate."""
    df = indices(levels, dim, boundary).withColumn("_x", L.coordinates(F.col("idx"), F.col("level"), boundary))
    return df.withColumn("value", function([F.get("_x", F.lit(d)) for d in range(dim)]).cast("double")).drop("_x")


def described(points: DataFrame, boundary: int = 2) -> DataFrame:
    """Adds to points with levels their coordinates, point levels, odd indices, and whether they lie on the boundary or a corner."""
    i, l = F.col("idx"), F.col("level")
    return points.withColumns(
        {
            "coords": L.coordinates(i, l, boundary),
            "point_level": F.zip_with(i, l, lambda a, b: L.point_level(a, b, boundary)),
            "odd_index": F.zip_with(i, l, lambda a, b: L.odd_index(a, b, boundary)),
            "left": F.zip_with(i, l, lambda a, b: L.predecessors(a, b, boundary)[0]),
            "right": F.zip_with(i, l, lambda a, b: L.predecessors(a, b, boundary)[1]),
            "boundary": L.on_boundary(i, l, boundary),
            "corner": L.is_corner(i, l),
        }
    )


def subspace_points(levels: DataFrame, sub: list[int], boundary: int = 2) -> DataFrame:
    """The points of the hierarchical subspace ``sub`` on each grid of ``levels`` that has it."""
    df = levels.where(L.leq(L.vec(sub), F.col("level"))).withColumn("idx", F.array().cast("array<bigint>"))
    for d, s in enumerate(sub):
        at = L.subspace_indices(F.lit(s), F.get("level", F.lit(d)), boundary)
        df = df.withColumn("_i", F.explode(at)).withColumn("idx", F.concat("idx", F.array("_i"))).drop("_i")
    return df


def corner_values(points: DataFrame) -> DataFrame:
    """The values at the corners of each grid (points with levels)."""
    return points.where(L.is_corner(F.col("idx"), F.col("level")))


def moved(index: Column, dim: int, by: int) -> Column:
    return F.transform(index, lambda i, d: F.when(d == dim, i + by).otherwise(i))


def neighbour(points: DataFrame, dim: int, periodic: bool = False) -> DataFrame:
    """Each point with ``below``, the value of its lower neighbour in dimension ``dim``: the layer exchanged upward.

    Without a neighbour it is null; a periodic dimension wraps around.
    """
    n = L.pow2(F.get("level", F.lit(dim)))
    up = F.transform("idx", lambda i, d: F.when(d == dim, (i + 1) % n if periodic else i + 1).otherwise(i))
    lower = points.select("task_id", "field_id", up.alias("idx"), F.col("value").alias("below"))
    return points.join(lower, POINT, "left")


def lower_to_upper(points: DataFrame, dim: int) -> DataFrame:
    """The points with the upper boundary in ``dim`` set to the lower one's values."""
    i, n = F.get("idx", F.lit(dim)), L.pow2(F.get("level", F.lit(dim)))
    low = points.where(i == 0).select("task_id", "field_id", F.transform("idx", lambda x, d: F.when(d == dim, n).otherwise(x)).alias("idx"), F.col("value").alias("_low"))
    return points.join(low, POINT, "left").withColumn("value", F.when(i == n, F.col("_low")).otherwise(F.col("value"))).drop("_low")


def gathered(points: DataFrame) -> DataFrame:
    """All points in column-major order, in one sorted run of files rather than on one machine."""
    n = F.transform("level", lambda l: L.points_1d(l, 2))
    return points.withColumn("position", L.linear_index(F.col("idx"), n)).orderBy("task_id", "field_id", "position")


def added(a: DataFrame, b: DataFrame, coeff: float) -> DataFrame:
    """``a + coeff * b`` for grids of the same level, point by point; a point that one lacks counts as 0 there."""
    other = b.select(*POINT, F.col("value").alias("_b"))
    return a.join(other, POINT, "full").withColumn("value", F.coalesce("value", F.lit(0.0)) + coeff * F.coalesce("_b", F.lit(0.0))).drop("_b")


# Decompositions: small, made on the driver.


def default_cuts(points: int, parts: int) -> list[int]:
    """First index of each of ``parts`` blocks, the larger blocks first."""
    small, more = divmod(points, parts)
    return [k * small + min(k, more) for k in range(parts)]


def standard_cuts(level: list[int], parts: list[int]) -> list[list[int]]:
    """The standard decomposition of a grid: block k of a dimension starts at k * 2^l / parts + 1, the first at 0."""
    return [[0] + [k * (1 << l) // p + 1 for k in range(1, p)] for l, p in zip(level, parts)]


def downsampled_cuts(cuts: list[list[int]], reference: list[int], level: list[int]) -> list[list[int]]:
    """The cuts on a coarser level: the first index at or above each, by coordinate (boundary 2)."""
    return [[-(-x // (1 << (r - l))) for x in c] for c, r, l in zip(cuts, reference, level)]


def owner(points: DataFrame, cuts: list[list[int]]) -> DataFrame:
    """``part``: the block, column-major, that each point lies in."""
    part, step = F.lit(0), 1
    for d, c in enumerate(cuts):
        i = F.get("idx", F.lit(d))
        k = sum(((i >= x).cast("int") for x in c), F.lit(0)) - 1
        part, step = part + k * step, step * len(c)
    return points.withColumn("part", part.cast("int"))


# Solutions known in closed form, as columns of coordinates.


def hyperplane(x: list[Column]) -> Column:
    return sum((F.lit(float(d + 1)) * c for d, c in enumerate(x)), F.lit(1.0))


def count_up(x: list[Column], runs: int = 1) -> Column:
    return runs * sum((F.lit(10.0**d) * c for d, c in enumerate(x)), F.lit(0.0))


def paraboloid(x: list[Column]) -> Column:
    out = F.lit(1.0 if len(x) % 2 else -1.0)
    for c in x:
        out = out * c * (c - 1)
    return out


def cosine_product(x: list[Column], t: float = 0.0) -> Column:
    import math

    out = F.lit(math.cos(math.pi * t))
    for c in x:
        out = out * F.cos(2 * math.pi * c)
    return out


def moving_gaussian(x: list[Column], t: float = 0.0) -> Column:
    return F.exp(-9.0 * sum((F.pow(c - (t % 1.0) - 0.5, 2) for c in x), F.lit(0.0)))
