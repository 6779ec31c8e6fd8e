"""Sparse grids as tables, and the combination of full grids through them.

The hierarchical values of all grids are added up by point, weighted with the scheme's coefficients:
one shuffle aggregation with partial sums. Points of different grids are the same if their dyadic
keys (index on the finest level) are. Scattering back is one join. ``sparse``: ``field_id, x_key, value`` and
whatever else names a scheme (``by``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadica.functions import levels as L

KEY = ["field_id", "x_key"]


def references(scheme: DataFrame, by: list[str], dim: int) -> DataFrame:
    """``top``: the finest level of each dimension among the grids of a scheme, which the keys refer to."""
    return scheme.groupBy(*by).agg(F.array(*[F.max(F.get("level", F.lit(d))) for d in range(dim)]).alias("top"))


def with_top(scheme: DataFrame, by: list[str], dim: int) -> DataFrame:
    """The scheme with its ``top`` beside each grid, so that no join over its points is needed."""
    w = Window.partitionBy(*by)
    return scheme.withColumn("top", F.array(*[F.max(F.get("level", F.lit(d))).over(w) for d in range(dim)]))


def keyed(points: DataFrame) -> DataFrame:
    """Points with ``level`` and ``top``: adds ``x_key`` and ``sub_level``."""
    return points.withColumn("x_key", L.canonical(F.col("idx"), F.col("level"), F.col("top"))).withColumn("sub_level", L.sub_level(F.col("x_key"), F.col("top")))


def gather(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sparse grid: sum of ``coeff * value`` by key, over keyed points with ``coeff``. Points without a value add nothing."""
    return points.groupBy(*(by or []), *KEY, "sub_level").agg(F.sum(F.col("coeff") * F.col("value")).alias("value"))


def scatter(points: DataFrame, sparse: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Keyed points with the sparse grid's values; a point whose subspace the sparse grid lacks keeps its own."""
    sg = sparse.select(*(by or []), *KEY, F.col("value").alias("_sg"))
    return points.join(sg, [*(by or []), *KEY], "left").withColumn("value", F.coalesce("_sg", "value")).drop("_sg")


def subspaces(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``sub_level, n_points`` over keyed points: the largest number any grid has; ``consistent`` if all have the same."""
    per = points.groupBy(*(by or []), "task_id", "field_id", "sub_level").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*(by or []), "sub_level").agg(F.max("n").alias("n_points"), (F.max("n") == F.min("n")).alias("consistent"))


def min_max(sparse: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least and largest coefficient of each subspace."""
    return sparse.groupBy(*(by or []), "sub_level").agg(F.min("value").alias("least"), F.max("value").alias("largest"))


def holders(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``groups``: the sorted groups that hold each subspace (keyed points with ``group_no``), without missing ones."""
    return points.groupBy(*(by or []), "sub_level").agg(F.array_sort(F.collect_set("group_no")).alias("groups"))


def shared_sets(held: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per set of two or more groups: how many subspaces they share."""
    return held.where(F.size("groups") > 1).groupBy(*(by or []), "groups").agg(F.count(F.lit(1)).alias("subspaces"))


def outgroup(held: DataFrame) -> DataFrame:
    """Subspaces that more than one group holds."""
    return held.where(F.size("groups") > 1)


def ingroup(held: DataFrame) -> DataFrame:
    return held.where(F.size("groups") == 1)


def reduced_top(lmin: list[int], lmax: list[int], by: list[int]) -> list[int]:
    """The reduced maximum: max(lmin, lmax - r)."""
    return [max(a, b - r) for a, b, r in zip(lmin, lmax, by)]


def below(sparse: DataFrame, top: list[int]) -> DataFrame:
    """The part of a sparse grid whose subspaces lie at or below ``top``: a chunk, or what is exchanged with a reduced maximum."""
    return sparse.where(L.leq(F.col("sub_level"), L.vec(top)))


def chunks(sizes: list[tuple[list[int], int]], budget: int) -> list[list[list[int]]]:
    """Subspaces in order, in chunks of at most ``budget`` points; a chunk has one subspace at least."""
    out: list[list[list[int]]] = []
    left = 0
    for level, n in sizes:
        if not out or n > left:
            out.append([])
            left = budget
        out[-1].append(level)
        left -= n
    return out


def total_points(sizes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The points of all subspaces, or of those that ``only`` (sub_level) names."""
    of = sizes if only is None else sizes.join(only.select("sub_level").distinct(), "sub_level", "left_semi")
    return of.agg(F.coalesce(F.sum("n_points"), F.lit(0)).alias("n_points"))


def conjoint(sparse: DataFrame, levels: DataFrame) -> DataFrame:
    """The part of a sparse grid that lies in the subspaces of ``levels`` (level): the extra sparse grid two systems exchange. :func:`updated` copies it back."""
    return sparse.join(levels.select(F.col("level").alias("sub_level")).distinct(), "sub_level", "left_semi")


def updated(sparse: DataFrame, other: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``sparse`` with the values of ``other`` where it has any."""
    k = [*(by or []), *KEY]
    return sparse.join(other.select(*k, F.col("value").alias("_o")), k, "left").withColumn("value", F.coalesce("_o", "value")).drop("_o")


def summed(*parts: DataFrame) -> DataFrame:
    """The sum of sparse grids of several systems, by key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEY, "sub_level").agg(F.sum("value").alias("value"))


def unified_sizes(a: DataFrame, b: DataFrame, largest: bool) -> DataFrame:
    """Sizes of the subspaces of two systems: the larger of each, or the smaller, 0 where one lacks it."""
    j = a.select("sub_level", F.col("n_points").alias("a")).join(b.select("sub_level", F.col("n_points").alias("b")), "sub_level", "full")
    x, y = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return j.select("sub_level", (F.greatest(x, y) if largest else F.least(x, y)).alias("n_points"))


def common_sizes(*systems: DataFrame) -> DataFrame:
    """Subspaces that more than one of the systems has."""
    out = systems[0].select("sub_level", "n_points")
    for s in systems[1:]:
        out = out.unionByName(s.select("sub_level", "n_points"))
    return out.where("n_points > 0").groupBy("sub_level").agg(F.max("n_points").alias("n_points"), F.count(F.lit(1)).alias("systems")).where("systems > 1")


def onto(sparse: DataFrame, levels: DataFrame, dim: int, by: list[str] | None = None) -> DataFrame:
    """The sparse grid's hierarchical values on the grids of ``levels`` (task_id, level, top): 0 where it has none."""
    from dyadica.operators.grids import indices

    fields = sparse.select(*(by or []), "field_id").distinct()
    on = by or ["_all"]
    if not by:  # each field on each grid
        fields, levels = fields.withColumn("_all", F.lit(1)), levels.withColumn("_all", F.lit(1))
    base = levels.join(fields, on).drop("_all")
    pts = keyed(indices(base, dim)).withColumn("value", F.lit(0.0))
    return scatter(pts, sparse, by)


def on_top(sparse: DataFrame, dim: int, bases: list[str] | str = "hat") -> DataFrame:
    """Nodal values of sparse grids (task_id, field_id, x_key, top, value) on all points of their reference grids.

    The keys are indices there, so points that a sparse grid lacks are filled into the poles as 0 and never joined.
    """
    from dyadica.operators.transform import dehierarchize

    at = sparse.select("task_id", "field_id", F.col("x_key").alias("idx"), F.coalesce("value", F.lit(0.0)).alias("value"), F.col("top").alias("level"))
    return dehierarchize(at, dim, bases, missing=0.0)
