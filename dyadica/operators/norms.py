"""Norms of grids and of differences, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadica.functions import levels as L

BY = ["task_id", "field_id"]


def lp(value: Column, p: int) -> Column:
    """(sum |v|^p)^(1/p) over the rows; the largest |v| for p = 0. Missing values are left out."""
    return F.max(F.abs(value)) if p == 0 else F.pow(F.sum(F.pow(F.abs(value), F.lit(float(p)))), F.lit(1.0 / p))


def serial(points: DataFrame, ps: tuple[int, ...] = (0, 1, 2), by: list[str] = BY) -> DataFrame:
    """Unweighted norms of each grid."""
    return points.groupBy(*by).agg(*[lp(F.col("value"), p).alias(f"l{p}") for p in ps])


def weighted(points: DataFrame, p: int, by: list[str] = BY) -> DataFrame:
    """The norm of points with levels, a point on k boundaries counting 2^-k: (sum w |v|^p * (prod h)^p)^(1/p).

    This is an integral for p = 1 only; :func:`l2_true` is one for p = 2.
    """
    if p == 0:
        return points.groupBy(*by).agg(F.max(F.abs(F.col("value"))).alias("norm"))
    edges = F.aggregate(F.zip_with("idx", "level", lambda i, l: F.when((i == 0) | (i == L.pow2(l)), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    term = F.pow(F.lit(2.0), -edges) * F.pow(F.abs(F.col("value")), F.lit(float(p))) * F.pow(L.inner_integral(F.col("level")), F.lit(float(p)))
    return points.groupBy(*by).agg(F.pow(F.sum(term), F.lit(1.0 / p)).alias("norm"))


def l2_true(points: DataFrame, by: list[str] = BY) -> DataFrame:
    edges = F.aggregate(F.zip_with("idx", "level", lambda i, l: F.when((i == 0) | (i == L.pow2(l)), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return points.groupBy(*by).agg(F.sqrt(F.sum(F.pow(F.lit(2.0), -edges) * F.col("value") * F.col("value") * L.inner_integral(F.col("level")))).alias("norm"))


def normalized(points: DataFrame, p: int, by: list[str] = BY) -> DataFrame:
    """The points divided by their grid's norm; a grid of norm 0 stays as it is."""
    n = points.groupBy(*by).agg(lp(F.col("value"), p).alias("_n"))
    return points.join(n, by).withColumn("value", F.when(F.col("_n") != 0, F.col("value") / F.col("_n")).otherwise(F.col("value"))).drop("_n")


def combined(norms: DataFrame, scheme: DataFrame, by: list[str]) -> DataFrame:
    """The sum over the tasks of coeff times the norm."""
    return norms.join(scheme.select(*by, "task_id", "coeff"), "task_id").groupBy(*by, "field_id").agg(F.sum(F.col("coeff") * F.col("norm")).alias("norm"))


def compared(a: DataFrame, b: DataFrame, key: list[str], normalize: bool = False) -> DataFrame:
    """Norms of two dumps and of their difference, joined by key; a value that one lacks counts as 0.

    ``normalize`` divides each by its own 2-norm first.
    """
    j = a.select(*key, F.col("value").alias("a")).join(b.select(*key, F.col("value").alias("b")), key, "full").select(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    x, y = F.col("a"), F.col("b")
    if normalize:
        scale = j.agg(lp(x, 2).alias("sa"), lp(y, 2).alias("sb")).first()
        x, y = x / (scale["sa"] or 1.0), y / (scale["sb"] or 1.0)
    out = []
    for name, v in (("a", x), ("b", y), ("diff", x - y)):
        out += [lp(v, p).alias(f"{name}_l{p}") for p in (0, 1, 2)]
    return j.agg(F.count(F.lit(1)).alias("n"), *out)


def mc_norms(values: DataFrame) -> DataFrame:
    """Norms of sampled values: the largest, the sum of sizes over n, and the root of the sum of squares over n (not over its root)."""
    v = F.col("value")
    return values.agg(F.count(v).alias("n"), F.max(F.abs(v)).alias("linf"), (F.sum(F.abs(v)) / F.count(v)).alias("l1"), (F.sqrt(F.sum(v * v)) / F.count(v)).alias("l2"))
