"""Multiscale transforms of grids, one dimension after the other, along poles.

A pole is all points of a grid that differ in one index. It is gathered into an array (bounded by
the level: 2^l + 1 values) and transformed by a fold over the levels in the JVM; each step of the fold updates the
points of one parity. Six bases: hat, full weighting and biorthogonal, plain and periodic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadica.functions import levels as L

BASES = ("hat", "hat_periodic", "fullweighting", "fullweighting_periodic", "biorthogonal", "biorthogonal_periodic")

# Fixed weights of the lifting steps: (parity updated, weight of the point itself, weight of each neighbour,
# and the weights of an end point and of its one neighbour). Forward steps run from the finest level down, backward from the coarsest up.
_FORWARD = {
    "hat": [("odd", 1.0, -0.5, None)],
    "fullweighting": [("even", 0.5, 0.25, (0.5, 0.5)), ("odd", 1.0, -0.5, None)],
    "biorthogonal": [("odd", 1.0, -0.5, None), ("even", 1.0, 0.25, (1.0, 0.5))],
}
_BACKWARD = {
    "hat": [("odd", 1.0, 0.5, None)],
    "fullweighting": [("odd", 1.0, 0.5, None), ("even", 2.0, -0.5, (2.0, -1.0))],
    "biorthogonal": [("even", 1.0, -0.25, (1.0, -0.5)), ("odd", 1.0, 0.5, None)],
}


def _kernel(w: Column, lmax: Column, lmin: Column, basis: str, forward: bool) -> Column:
    """The transform of a pole with both ends, as an array of 2^lmax + 1 values."""
    kind, periodic = basis.removesuffix("_periodic"), basis.endswith("_periodic")
    steps = (_FORWARD if forward else _BACKWARD)[kind]
    n = len(steps)
    end = L.pow2(lmax).cast("int")

    def update(acc: Column, k: Column, step: tuple) -> Column:
        parity, own, side, ends = step
        turn = F.floor(k / n).cast("int")
        s = L.pow2(turn if forward else lmax - lmin - 1 - turn).cast("int")

        def value(v: Column, i: Column) -> Column:
            inner = own * v + side * (F.get(acc, i - s) + F.get(acc, i + s))
            if parity == "odd":
                return F.when(i % (2 * s) == s, inner).otherwise(v)
            if periodic:  # both ends are one point with two neighbours: the inner rule, on the mean of the two
                last = 0.5 * own * (F.get(acc, F.lit(0)) + F.get(acc, end)) + side * (F.get(acc, s) + F.get(acc, end - s))
                left = right = last
            else:
                left, right = ends[0] * v + ends[1] * F.get(acc, s), ends[0] * v + ends[1] * F.get(acc, end - s)
            return F.when(i == 0, left).when(i == end, right).when(i % (2 * s) == 0, inner).otherwise(v)

        return F.transform(acc, value)

    def step(acc: Column, k: Column) -> Column:
        if n == 1:
            return update(acc, k, steps[0])
        return F.when(k % 2 == 0, update(acc, k, steps[0])).otherwise(update(acc, k, steps[1]))

    turns = F.sequence(F.lit(0), F.greatest(n * (lmax - lmin) - 1, F.lit(0)))
    return F.when(lmax > lmin, F.aggregate(turns, w, step)).otherwise(w)


def _laid_out(p: Column, n: Column, missing: float | None) -> Column:
    """The values of a pole's points (i, v, sorted), ``missing`` where there is none: each point with the gap before it, in one pass."""
    gap = lambda k: F.array_repeat(F.lit(missing).cast("double"), k.cast("int"))
    at = F.filter(p, lambda x: (x["i"] >= 0) & (x["i"] < n))
    last = lambda q, k: F.coalesce(F.get(q, k)["i"], F.lit(-1).cast("bigint"))
    runs = lambda q: F.transform(q, lambda x, k: F.when(x["i"] == last(q, k - 1), F.array().cast("array<double>")).otherwise(F.concat(gap(x["i"] - last(q, k - 1) - 1), F.array(x["v"]))))
    return F.get(F.transform(F.array(at), lambda q: F.concat(F.flatten(runs(q)), gap(n - 1 - last(q, F.size(q) - 1)))), F.lit(0))


def along(points: DataFrame, dim: int, basis: str = "hat", *, forward: bool = True, boundary: int = 2, lmin: int = 0, keep: list[str] | None = None, missing: float | None = None) -> DataFrame:
    """Points with levels, transformed in dimension ``dim``; the level of a dimension at or below ``lmin`` leaves it as it is.

    A point missing from its pole counts as one without a value, and every value that depends on it is null, unless
    ``missing`` is its value. Columns of ``keep``, which are the same on all of a grid, stay.
    Without a boundary only the hat basis is defined, missing parents being 0.
    """
    if basis not in BASES:
        raise ValueError(f"no such basis: {basis}")
    if boundary == 0 and not basis.startswith("hat"):
        raise ValueError("without a boundary only the hat basis is defined")
    l = F.get("level", F.lit(dim))
    rest = F.filter("idx", lambda x, d: d != dim)
    grid = ["task_id", "field_id", "level", *(keep or [])]
    poles = points.groupBy(*grid, rest.alias("rest")).agg(F.array_sort(F.collect_list(F.struct(F.get("idx", F.lit(dim)).alias("i"), F.col("value").alias("v")))).alias("p"))
    n = L.points_1d(l, boundary)
    whole = F.when(F.size("p") == n, F.col("p.v")).otherwise(_laid_out(F.col("p"), n, missing))
    zero = F.array(F.lit(0.0))
    if boundary == 0:
        whole = F.concat(zero, whole, zero)
    elif boundary == 1:
        whole = F.concat(whole, F.slice(whole, 1, 1))
    poles = poles.select(*grid, "rest", whole.alias("w"))
    done = poles.withColumn("w", _kernel(F.col("w"), l, F.lit(lmin), basis, forward))
    if boundary == 0:
        done = done.withColumn("w", F.slice("w", 2, F.size("w") - 2))
    elif boundary == 1:
        done = done.withColumn("w", F.slice("w", 1, F.size("w") - 1))
    # outer, for else the kernel is evaluated once more in a filter on the array's size
    out = done.select(*grid, "rest", F.posexplode_outer("w").alias("i", "value"))
    idx = F.concat(F.slice("rest", 1, dim) if dim else F.array().cast("array<bigint>"), F.array(F.col("i").cast("bigint")), F.slice("rest", dim + 1, 64))
    return out.select("task_id", "field_id", idx.alias("idx"), "value", "level", *(keep or []))


def hierarchize(points: DataFrame, dim: int, bases: list[str] | str = "hat", *, boundary: list[int] | int = 2, lmin: list[int] | int = 0, dims: list[int] | None = None, keep: list[str] | None = None, missing: float | None = None) -> DataFrame:
    """From nodal to hierarchical values in all dimensions, or those of ``dims``."""
    return _all(points, dim, bases, boundary, lmin, dims, True, keep, missing)


def dehierarchize(points: DataFrame, dim: int, bases: list[str] | str = "hat", *, boundary: list[int] | int = 2, lmin: list[int] | int = 0, dims: list[int] | None = None, keep: list[str] | None = None, missing: float | None = None) -> DataFrame:
    """The inverse of :func:`hierarchize`. With ``missing`` = 0 only the points that have a hierarchical value need be there, and all of the grid come out."""
    return _all(points, dim, bases, boundary, lmin, dims, False, keep, missing)


def _all(points: DataFrame, dim: int, bases: list[str] | str, boundary: list[int] | int, lmin: list[int] | int, dims: list[int] | None, forward: bool, keep: list[str] | None, missing: float | None) -> DataFrame:
    of = lambda x, d: x if isinstance(x, (int, str)) else x[d]
    # with a dimension without boundary points, no dimension may stop above level 0
    floor = 0 if any(of(boundary, d) == 0 for d in range(dim)) else None
    for d in range(dim) if dims is None else dims:
        points = along(points, d, of(bases, d), forward=forward, boundary=of(boundary, d), lmin=of(lmin, d) if floor is None else floor, keep=keep, missing=missing)
    return points


def default_basis(boundary: int) -> str:
    return "hat_periodic" if boundary == 1 else "hat"
