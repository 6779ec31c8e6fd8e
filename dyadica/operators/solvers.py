"""Time stepping of grids by column expressions: the periodic upwind advection solver, and user solvers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadica.functions import levels as L
from dyadica.operators.grids import POINT, neighbour


def stable(levels: list[list[int]], dt: float, velocity: float = 1.0) -> bool:
    """Whether an explicit step is stable on every grid: dt times the sum of velocity / h below 1."""
    return all(dt * sum(velocity * 2.0**l for l in level) < 1 for level in levels)


def advect(points: DataFrame, dim: int, dt: float, velocity: float = 1.0) -> DataFrame:
    """One upwind step on one-sided (periodic) grids, points with levels: v - dt * sum over d of velocity * (v - v below in d) / h_d."""
    df = points
    for d in range(dim):
        df = neighbour(df.select(*points.columns, *[f"_b{e}" for e in range(d)]), d, periodic=True).withColumnRenamed("below", f"_b{d}")
    slope = F.lit(0.0)
    for d in range(dim):
        slope = slope + (F.col("value") - F.col(f"_b{d}")) * F.pow(F.lit(2.0), F.get("level", F.lit(d)))
    return df.withColumn("value", F.col("value") - dt * velocity * slope).select(*points.columns)


def step_by(points: DataFrame, step: Callable, schema: str | None = None) -> DataFrame:
    """A user solver: ``step`` takes a task's points as a pandas frame and returns them changed. A task's grid must fit a worker."""
    return points.groupBy("task_id").applyInPandas(step, schema or points.schema)


def shifted_boundary(points: DataFrame, dim: int, along: int, offset: int, factor: float = 1.0) -> DataFrame:
    """The upper plane in ``dim`` set to the lower plane's values, moved by ``offset`` in ``along`` (wrapping) and scaled."""
    n, m = L.pow2(F.get("level", F.lit(dim))), L.pow2(F.get("level", F.lit(along)))
    to = F.transform("idx", lambda x, d: F.when(d == dim, n).when(d == along, F.pmod(x - offset, m)).otherwise(x))
    low = points.where(F.get("idx", F.lit(dim)) == 0).select("task_id", "field_id", to.alias("idx"), (F.col("value") * factor).alias("_low"))
    return points.join(low, POINT, "left").withColumn("value", F.when(F.get("idx", F.lit(dim)) == n, F.coalesce("_low", "value")).otherwise(F.col("value"))).drop("_low")
