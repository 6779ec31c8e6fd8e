"""Multilinear interpolation of grids at points, per task and combined over a scheme."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadica.functions import levels as L


def _names(prefix: str, dim: int) -> list[str]:
    return [f"{prefix}{d}" for d in range(dim)]


def _bits(dim: int) -> list[tuple[int, ...]]:
    return list(itertools.product((0, 1), repeat=dim))


def _placed(df: DataFrame, dim: int, boundary: int = 2, extrapolate: bool = False) -> DataFrame:
    """Rows with ``coords`` and ``level`` -> the same with ``_in`` (inside [0, 1]) and per dimension ``_l`` the level, ``_c`` the cell and ``_w`` the share of its upper end, in place of the two.

    Boundary 1 wraps to the first point; without a boundary, corners beyond the grid count as 0, or, with
    ``extrapolate``, the outer cell goes on. A point outside lies in a cell at the edge.
    """
    low, high = (1, 2) if boundary == 0 and extrapolate else (0, 1)
    df = df.withColumn("_in", F.forall("coords", lambda x: (x >= 0) & (x <= 1)))
    df = df.withColumns({f"_l{d}": F.get("level", F.lit(d)) for d in range(dim)} | {f"_s{d}": F.get("coords", F.lit(d)) * L.pow2(F.get("level", F.lit(d))) for d in range(dim)})
    df = df.withColumns({f"_c{d}": F.greatest(F.least(F.floor(f"_s{d}"), L.pow2(F.col(f"_l{d}")) - high), F.lit(low)).cast("bigint") for d in range(dim)})
    return df.withColumns({f"_w{d}": F.col(f"_s{d}") - F.col(f"_c{d}") for d in range(dim)}).drop("coords", "level", *_names("_s", dim))


def _on_all(points: DataFrame, levels: DataFrame, dim: int) -> DataFrame:
    """``points`` on each of the different levels among ``levels``; there are few, however many grids have them."""
    one = levels.agg(F.collect_set("level").alias("_levels"))
    return points.where(F.size("coords") == dim).crossJoin(F.broadcast(one)).withColumn("level", F.explode("_levels")).drop("_levels")


def _corners(cells: DataFrame, dim: int, boundary: int = 2) -> DataFrame:
    """Adds to rows with a cell its 2^dim corners: ``_k``, the corner's number, and ``idx``."""
    shift = 1 if boundary == 0 else 0
    out = []
    for bits in _bits(dim):
        idx = [F.col(f"_c{d}") + b - shift for d, b in enumerate(bits)]
        if boundary == 1:
            idx = [i % L.pow2(F.col(f"_l{d}")) for d, i in enumerate(idx)]
        out.append(F.array(*idx))
    return cells.select("*", F.posexplode(F.array(*out)).alias("_k", "idx"))


def _by_corner(dim: int) -> list:
    return [F.max(F.when(F.col("_k") == k, F.col("value"))).alias(f"_v{k}") for k in range(1 << dim)]


def _cells(grid: DataFrame, tasks: DataFrame, placed: DataFrame, dim: int, boundary: int = 2) -> DataFrame:
    """task_id, field_id, cell, ``_v0`` to ``_v(2^dim - 1)``: the corners of the cells that points lie in, looked up once a cell and not once a point."""
    at = [*_names("_l", dim), *_names("_c", dim)]
    levels = tasks.where(F.size("level") == dim).select("task_id", *[F.get("level", F.lit(d)).alias(f"_l{d}") for d in range(dim)])
    fields = grid.select("task_id", "field_id").distinct().join(levels, "task_id")
    frame = fields.join(placed.select(*at).distinct().hint("merge"), _names("_l", dim))
    met = _corners(frame, dim, boundary).hint("merge").join(grid.select("task_id", "field_id", "idx", "value"), ["task_id", "field_id", "idx"], "left")
    return met.groupBy("task_id", "field_id", *at).agg(*_by_corner(dim))


def _value(dim: int, boundary: int = 2, outside: Column | float = 0.0, corner: Callable[[int], Column] = lambda k: F.col(f"_v{k}")) -> Column:
    """The value at a placed point, from the corners of its cell: null if a corner that counts has none, without a boundary 0 in its place."""
    total = F.lit(0.0)
    for k, bits in enumerate(_bits(dim)):
        weight = F.lit(1.0)
        for d, b in enumerate(bits):
            weight = weight * (F.col(f"_w{d}") if b else 1 - F.col(f"_w{d}"))
        part = F.when(weight == 0, 0.0).otherwise(weight * corner(k))
        total = total + (F.coalesce(part, F.lit(0.0)) if boundary == 0 else part)
    return F.when(F.col("_in"), total).when(~F.col("_in"), outside)


def _met(placed: DataFrame, cells: DataFrame, at: list[str]) -> DataFrame:
    """Points beside what is known of their cells. The result is larger than either side, so neither side's size says in how many parts to make it."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, *at).hint("merge").join(cells.repartition(n, *at), at)


def at_points(grid: DataFrame, tasks: DataFrame, points: DataFrame, dim: int, boundary: int = 2, extrapolate: bool = False) -> DataFrame:
    """pt_id, task_id, field_id, value: each field of each task at each point.

    0 outside [0, 1]; null if a corner that counts has no value. ``grid`` must be clean; a point without
    coordinates is left out. Points are placed once for each of the levels, and meet the grids cell by cell.
    """
    grids = tasks.where(F.size("level") == dim)
    placed = _placed(_on_all(points.select("pt_id", "coords"), grids, dim), dim, boundary, extrapolate)
    cells = _cells(grid, grids, placed, dim, boundary)
    return _met(placed, cells, [*_names("_l", dim), *_names("_c", dim)]).select("pt_id", "task_id", "field_id", _value(dim, boundary).alias("value"))


def _combined_cells(grid: DataFrame, tasks: DataFrame, scheme: DataFrame, points: DataFrame, dim: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points placed on the finest grids of the schemes, and the cells of these with the schemes' combined values at the corners.

    The grids are nested, so that a scheme's combined function is multilinear on the cells of its finest grid (boundary 2), and a
    corner that counts for a point there lacks a value if and only if some grid lacks one that counts.
    ``_out`` is the sum at points outside.
    """
    ls, cs = _names("_l", dim), _names("_c", dim)
    on = scheme.select(*by, "task_id", "coeff").join(tasks.where(F.size("level") == dim).select("task_id", "level"), "task_id").join(grid.select("task_id").distinct(), "task_id", "left_semi")
    w = Window.partitionBy(*by)
    on = on.withColumn("top", F.array(*[F.max(F.get("level", F.lit(d))).over(w) for d in range(dim)]))
    placed = _placed(_on_all(points, on.select(F.col("top").alias("level")), dim), dim)
    need = placed.select(*ls, *cs).distinct()
    corners = _corners(need, dim).withColumn("top", F.array(*ls))
    # the corners as points of all levels that go with their reference level
    pairs = on.groupBy("top").agg(F.collect_set("level").alias("_levels"))
    nodes = corners.select("top", "idx").distinct().hint("merge").join(pairs, "top").select("top", "idx", L.coordinates(F.col("idx"), F.col("top")).alias("coords"), F.explode("_levels").alias("level"))
    nodes = _placed(nodes, dim)
    own = _cells(grid, tasks, nodes, dim).hint("merge").join(on.drop("level"), "task_id")
    v = _value(dim)
    at_nodes = _met(nodes, own, ["top", *ls, *cs]).select(*by, "top", "idx", "field_id", "coeff", v.alias("v"))
    sums = at_nodes.groupBy(*by, "top", "idx", "field_id").agg(F.sum(F.col("coeff") * F.col("v")).alias("s"), F.count("v").alias("n"), F.count(F.lit(1)).alias("m"), F.sum(F.col("coeff") * 0.0).alias("_out"))
    sums = sums.select(*by, "top", "idx", "field_id", F.when(F.col("n") == F.col("m"), F.col("s")).alias("value"), "_out")
    cells = corners.hint("merge").join(sums, ["top", "idx"]).groupBy(*by, "field_id", *ls, *cs).agg(*_by_corner(dim), F.max("_out").alias("_out"))
    return placed, cells


def combined_at(grid: DataFrame, tasks: DataFrame, scheme: DataFrame, points: DataFrame, dim: int, by: list[str] | None = None) -> DataFrame:
    """by, pt_id, field_id, value: as :func:`combined` of :func:`at_points` with both boundaries, but a point is evaluated once for each scheme, not for each of its grids. Other columns of ``points`` stay."""
    keep = [c for c in points.columns if c not in ("pt_id", "coords")]
    placed, cells = _combined_cells(grid, tasks, scheme, points, dim, by or [])
    return _met(placed, cells, [*_names("_l", dim), *_names("_c", dim)]).select(*(by or []), "pt_id", "field_id", _value(dim, outside=F.col("_out")).alias("value"), *keep)


def fields_summed_at(grid: DataFrame, tasks: DataFrame, scheme: DataFrame, points: DataFrame, dim: int, by: list[str] | None = None) -> DataFrame:
    """by, pt_id, value, systems: the sum over the fields of :func:`combined_at`, nulls left out, and their number. A point meets all fields of a cell at once, so the sum needs no shuffle."""
    at = [*_names("_l", dim), *_names("_c", dim)]
    placed, cells = _combined_cells(grid, tasks, scheme, points.select("pt_id", "coords"), dim, by or [])
    vs = _names("_v", 1 << dim)
    cells = cells.groupBy(*(by or []), *at).agg(F.collect_list(F.struct(*vs, "_out")).alias("_f"))
    value = lambda f: _value(dim, outside=f["_out"], corner=lambda k: f[f"_v{k}"])
    start = F.lit(None).cast("double")
    total = F.aggregate("_f", start, lambda acc, f: F.coalesce(acc + value(f), acc, value(f)))
    return _met(placed, cells, at).select(*(by or []), "pt_id", total.alias("value"), F.size("_f").cast("bigint").alias("systems"))


def combined(values: DataFrame, scheme: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of ``coeff * value`` over the tasks of a scheme at each point; null if a task has no value there."""
    j = values.join(scheme.select(*(by or []), "task_id", "coeff"), "task_id")
    total = j.groupBy(*(by or []), "pt_id", "field_id").agg(F.sum(F.col("coeff") * F.col("value")).alias("v"), F.count("value").alias("n"), F.count(F.lit(1)).alias("m"))
    return total.select(*(by or []), "pt_id", "field_id", F.when(F.col("n") == F.col("m"), F.col("v")).alias("value"))


def resampled(grid: DataFrame, tasks: DataFrame, target: list[int], dim: int, boundary: int = 2) -> DataFrame:
    """Each grid evaluated at the points of a grid of level ``target``: task_id, field_id, idx, value."""
    from dyadica.operators.grids import indices

    spark = grid.sparkSession
    dst = indices(spark.range(1).select(L.vec(target).alias("level")), dim, boundary)
    n = F.transform("level", lambda l: L.points_1d(l, boundary))
    dst = dst.select(L.linear_index(F.col("idx"), n).alias("pt_id"), L.coordinates(F.col("idx"), F.col("level"), boundary).alias("coords"))
    sizes = F.array(*[F.lit((1 << t) + boundary - 1).cast("bigint") for t in target])
    return at_points(grid, tasks, dst, dim, boundary).select("task_id", "field_id", L.vector_index(F.col("pt_id"), sizes).alias("idx"), "value")


def random_points(spark, count: int, dim: int, seed: int = 0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``count`` uniform points, the same for the same seed whatever the partitioning: each coordinate is a hash of its place."""
    x = [(F.xxhash64("id", F.lit(d), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) * (high - low) + low for d in range(dim)]
    return spark.range(count).select(F.col("id").alias("pt_id"), F.array(*x).alias("coords"))


def mc_errors(values: DataFrame, exact: DataFrame | Column, by: list[str] | None = None) -> DataFrame:
    """Greatest, mean and mean square deviation from the exact values, of each of ``by``, and each relative to the exact size.

    ``exact``: pt_id, value, or a column of ``values``, which needs no join.
    """
    by = by or []
    if isinstance(exact, Column):
        j = values.select(*by, F.col("value").alias("v"), exact.alias("e"))
    else:
        j = values.select(*by, "pt_id", F.col("value").alias("v")).join(exact.select("pt_id", F.col("value").alias("e")), "pt_id")
    d, e = F.abs(F.col("v") - F.col("e")), F.abs("e")
    s = j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("linf"), F.avg(d).alias("l1"), F.avg(d * d).alias("l2"), F.max(e).alias("e_linf"), F.avg(e).alias("e_l1"), F.avg(e * e).alias("e_l2"))
    return s.select(*by, "n", "linf", "l1", "l2", *[F.when(F.col(f"e_{x}") != 0, F.col(x) / F.col(f"e_{x}")).alias(f"rel_{x}") for x in ("linf", "l1", "l2")])


def moments(values: DataFrame, points: DataFrame | list[Column], dim: int, by: list[str] | None = None) -> DataFrame:
    """Monte Carlo mass and momenta: the means of f, of each x_d f and of the product of all x times f.

    ``points``: pt_id, coords, or the coordinates as columns of ``values``, which needs no join.
    """
    by = by or []
    if isinstance(points, list):
        j, x = values, points
    else:
        j = values.select(*by, "pt_id", "value").join(points.select("pt_id", "coords"), "pt_id")
        x = [F.get("coords", F.lit(d)) for d in range(dim)]
    prod = F.lit(1.0)
    for c in x:
        prod = prod * c
    return j.groupBy(*by).agg(F.avg("value").alias("mass"), *[F.avg(c * F.col("value")).alias(f"momentum_{d}") for d, c in enumerate(x)], F.avg(prod * F.col("value")).alias("momentum_all"))


def stretched(coords, source: int, target: int):
    """Coordinates on a grid of level ``source`` in dimension 0 whose box is a = 2^(source - target) times as long, about the middle: (x - b) / a, b = (1 - a) / 2."""
    a = 2.0 ** (source - target)
    b = 0.5 - 0.5 * a
    return F.transform(coords, lambda x, d: F.when(d == 0, (x - b) / a).otherwise(x))


def added_onto(target: DataFrame, grid: DataFrame, tasks: DataFrame, level: list[int], dim: int, coeff: float = 1.0, stretch_from: int | None = None) -> DataFrame:
    """``target`` (field_id, idx, value on a grid of ``level``) plus ``coeff`` times each of ``grid``'s fields, evaluated there.

    With ``stretch_from`` the evaluated grid is of that level in dimension 0 and is stretched before; outside it counts 0.
    """
    from dyadica.operators.grids import indices

    spark = grid.sparkSession
    dst = indices(spark.range(1).select(L.vec(level).alias("level")), dim)
    n = F.transform("level", lambda l: L.points_1d(l, 2))
    coords = L.coordinates(F.col("idx"), F.col("level"))
    if stretch_from is not None:
        coords = stretched(coords, stretch_from, level[0])
    at = dst.select(L.linear_index(F.col("idx"), n).alias("pt_id"), coords.alias("coords"))
    sizes = F.array(*[F.lit((1 << t) + 1).cast("bigint") for t in level])
    extra = at_points(grid, tasks, at, dim).groupBy("field_id", "pt_id").agg(F.sum("value").alias("_v")).select("field_id", L.vector_index(F.col("pt_id"), sizes).alias("idx"), "_v")
    return target.join(extra, ["field_id", "idx"], "full").withColumn("value", F.coalesce("value", F.lit(0.0)) + coeff * F.coalesce("_v", F.lit(0.0))).drop("_v")
