"""Column functions over level and index vectors, and the geometry of dyadic grids on [0, 1]^d.

A level vector is ``array<int>``, an index vector ``array<bigint>``. All are plain column
expressions; a null vector, or vectors of different length where two are taken, give null.
Boundary per dimension: 0 no boundary points, 1 the left one (periodic), 2 both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT, LONG = "int", "bigint"


def vec(v: list[int]) -> Column:
    return F.array(*[F.lit(int(x)) for x in v])


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def leq(a: Column, b: Column) -> Column:
    """The partial order: every component of ``a`` is at most that of ``b`` (arrays themselves compare lexicographically)."""
    return _same(a, b, F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda t: t))


def lt(a: Column, b: Column) -> Column:
    return _same(a, b, F.forall(F.zip_with(a, b, lambda x, y: x < y), lambda t: t))


def add(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y))


def sub(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x - y))


def total(v: Column) -> Column:
    """The sum of the components (of levels: the level sum)."""
    return F.aggregate(v, F.lit(0).cast(LONG), lambda acc, x: acc + x)


def product(v: Column) -> Column:
    return F.aggregate(v, F.lit(1).cast(LONG), lambda acc, x: acc * x)


def parse(text: Column) -> Column:
    """A level vector from text such as ``"3 3 "``; text without a number gives an empty vector."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast(INT))


def pow2(n: Column) -> Column:
    """2^n as a bigint, for n from 0 to 62."""
    return F.call_function("shiftleft", F.lit(1).cast(LONG), n.cast(INT))


def points_1d(level: Column, boundary: int) -> Column:
    """Points of one dimension: 2^l + boundary - 1; at level 0 as many as there are boundary points."""
    return F.when(level > 0, pow2(level) + (boundary - 1)).otherwise(F.lit(boundary)).cast(LONG)


def dof_nodal(level: Column, boundary: int = 2) -> Column:
    """Points of a full grid."""
    return product(F.transform(level, lambda l: points_1d(l, boundary)))


def hierarchical_1d(level: Column, boundary: int) -> Column:
    """Points of a hierarchical subspace in one dimension; level 1 holds the boundary points too."""
    return F.when(level > 1, pow2(level - 1)).otherwise(F.lit(1 + boundary)).cast(LONG)


def dof_hierarchical(level: Column, boundary: int = 2) -> Column:
    return product(F.transform(level, lambda l: hierarchical_1d(l, boundary)))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def coordinates(index: Column, level: Column, boundary: int = 2) -> Column:
    """Coordinates of a point: (i + 1 if there is no boundary) / 2^l."""
    shift = 1 if boundary == 0 else 0
    return F.zip_with(index, level, lambda i, l: (i + shift) / F.pow(F.lit(2.0), l))


def lowbit(i: Column) -> Column:
    return i.bitwiseAND(-i)


def _ctz(i: Column) -> Column:
    return F.log2(lowbit(i).cast("double")).cast(INT)


def point_level(i: Column, level: Column, boundary: int = 2) -> Column:
    """Level of a point of one dimension: 0 on the boundary, else the level minus the trailing zeros of the index."""
    j = i + (1 if boundary == 0 else 0)
    edge = (j == 0) | (j == pow2(level))
    return F.when(edge, F.lit(0)).otherwise(level - _ctz(F.when(edge, 1).otherwise(j))).cast(INT)


def odd_index(i: Column, level: Column, boundary: int = 2) -> Column:
    """Index of a point on its own level: halved until it is odd; a boundary point has 0 or 1 on level 0."""
    j = i + (1 if boundary == 0 else 0)
    return F.when(j == 0, F.lit(0)).when(j == pow2(level), F.lit(1)).otherwise((j / lowbit(F.when(j == 0, 1).otherwise(j)))).cast(LONG)


def predecessors(i: Column, level: Column, boundary: int = 2) -> tuple[Column, Column]:
    """Left and right hierarchical predecessors of a point in one dimension, null where there is none.

    With a one-sided boundary the right end is the virtual index 2^l.
    """
    j = i + (1 if boundary == 0 else 0)
    shift = 1 if boundary == 0 else 0
    end = pow2(level)
    inner = (j > 0) & (j < end)
    low = lowbit(F.when(j == 0, 1).otherwise(j))
    left, right = j - low, j + low
    if boundary == 0:
        left, right = F.when(left > 0, left), F.when(right < end, right)
    return F.when(inner, left - shift), F.when(inner, right - shift)


def subspace_first(level: Column, lmax: Column, boundary: int = 2) -> Column:
    """First index of a subspace of one dimension on a grid of level ``lmax``."""
    first = F.when(level > 1, pow2(lmax - level)).otherwise(F.lit(0) if boundary else pow2(lmax - 1))
    return (first - F.when(F.lit(boundary == 0), 1).otherwise(0)).cast(LONG)


def subspace_stride(level: Column, lmax: Column) -> Column:
    return F.when(level > 1, pow2(lmax - level + 1)).otherwise(pow2(lmax - 1)).cast(LONG)


def subspace_indices(level: Column, lmax: Column, boundary: int = 2) -> Column:
    """Indices of a subspace's points in one dimension. Without a boundary, level 1 is the one point in the middle."""
    n = hierarchical_1d(level, boundary)
    first, stride = subspace_first(level, lmax, boundary), subspace_stride(level, lmax)
    return F.sequence(first, first + (n - 1) * stride, stride)


def canonical(index: Column, level: Column, top: Column) -> Column:
    """The exact dyadic key of a point: its index on the reference level ``top`` (boundary 1 or 2)."""
    return F.transform(index, lambda i, d: i * pow2(F.get(top, d) - F.get(level, d)))


def sub_level(key: Column, top: Column) -> Column:
    """The storage subspace of a dyadic key: levels from 1 up, the boundary belonging to level 1."""
    return F.transform(key, lambda x, d: F.greatest(F.lit(1), point_level(x, F.get(top, d))))


def linear_index(index: Column, extents: Column) -> Column:
    """Column-major position: dimension 0 varies fastest."""
    start = F.struct(F.lit(0).cast(LONG).alias("at"), F.lit(1).cast(LONG).alias("step"))
    pairs = F.arrays_zip(index.alias("i"), extents.alias("n"))
    return F.aggregate(pairs, start, lambda acc, p: F.struct((acc["at"] + p["i"] * acc["step"]).alias("at"), (acc["step"] * p["n"]).cast(LONG).alias("step")))["at"]


def vector_index(position: Column, extents: Column) -> Column:
    """The index vector at a column-major position."""
    start = F.struct(position.cast(LONG).alias("rest"), F.array().cast("array<bigint>").alias("v"))
    return F.aggregate(extents, start, lambda acc, n: F.struct(F.floor(acc["rest"] / n).cast(LONG).alias("rest"), F.concat(acc["v"], F.array((acc["rest"] % n).cast(LONG))).alias("v")))["v"]


def on_boundary(index: Column, level: Column, boundary: int = 2) -> Column:
    """Whether a point lies on the boundary in some dimension."""
    if boundary == 0:
        return F.lit(False)
    return F.exists(F.zip_with(index, level, lambda i, l: (i == 0) | (i == pow2(l))), lambda t: t)


def is_corner(index: Column, level: Column) -> Column:
    return F.forall(F.zip_with(index, level, lambda i, l: (i == 0) | (i == pow2(l))), lambda t: t)


def spacing(level: Column) -> Column:
    return F.transform(level, lambda l: F.pow(F.lit(2.0), -l))


def inner_integral(level: Column) -> Column:
    """Integral of an inner basis function: the product of the spacings."""
    return F.pow(F.lit(2.0), -total(level))


def highest_below(level: Column, nodal: Column, reference: Column) -> Column:
    """Highest index, in a one-dimensional subspace of ``level``, of a point below ``nodal`` on the reference level; -1 if there is none."""
    end = pow2(reference)
    one = F.when(nodal <= 0, -1).when(nodal >= end, 2).when(nodal * 2 >= end, 1).otherwise(0)
    step = pow2(reference - level)
    more = F.when(nodal > step, F.ceil(0.5 * (nodal / step - 1.0)) - 1).otherwise(-1)
    return F.when(level <= 1, one).otherwise(more).cast(LONG)


def round9(c: Column) -> Column:
    """Rounded to nine places, without a negative zero."""
    return F.round(c, 9) + F.lit(0.0)
