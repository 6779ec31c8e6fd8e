from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from dyadica.functions import levels as L
from dyadica.functions import numbers
from dyadica.operators import combine, grids, interp, norms, scheme, transform
from dyadica.operators.solvers import advect, stable


def tasks(spark, levels, coeffs=None):
    rows = [(i, list(l), float(coeffs[i] if coeffs else 1.0), 0) for i, l in enumerate(levels)]
    return spark.createDataFrame(rows, "task_id bigint, level array<int>, coeff double, field_id int")


def grid(spark, levels, function, boundary=2):
    t = tasks(spark, levels)
    return grids.filled(t, len(levels[0]), function, boundary).select("task_id", "field_id", "idx", "value", "level")


def values(df):
    return {(r["task_id"], tuple(r["idx"])): r["value"] for r in df.collect()}


@pytest.mark.parametrize("boundary", [0, 1, 2])
def test_points_and_geometry(spark, boundary):
    df = grid(spark, [(2, 3)], grids.hyperplane, boundary)
    assert df.count() == (3 + boundary) * (7 + boundary)
    d = grids.described(df, boundary)
    for r in d.collect():
        for k, l in enumerate((2, 3)):
            i = r["idx"][k] + (boundary == 0)
            assert r["coords"][k] == i / 2**l
            lev = 0 if i in (0, 2**l) else l - int(math.log2(i & -i))
            assert r["point_level"][k] == lev
            if 0 < i < 2**l:
                assert r["odd_index"][k] * 2 ** (l - lev) == i


@pytest.mark.parametrize("boundary", [0, 1, 2])
def test_subspaces_make_up_the_grid(spark, boundary):
    """The hierarchical subspaces at or below a grid have each of its points once."""
    t = tasks(spark, [(3, 2)])
    seen = []
    for a in range(1, 4):
        for b in range(1, 3):
            seen += [tuple(r["idx"]) for r in grids.subspace_points(t, [a, b], boundary).collect()]
    want = sorted(tuple(r["idx"]) for r in grids.indices(t, 2, boundary).collect())
    assert sorted(seen) == want


@pytest.mark.parametrize("basis,boundary", [("hat", 0), ("hat", 1), ("hat", 2), ("fullweighting", 2), ("fullweighting_periodic", 1), ("biorthogonal", 2), ("biorthogonal_periodic", 1)])
@pytest.mark.parametrize("lmin", [0, 1, 3])
def test_round_trip(spark, basis, boundary, lmin):
    df = grid(spark, [(3, 2)], lambda x: F.sin(3 * x[0]) + x[1] * x[1] * x[0], boundary)
    there = transform.hierarchize(df, 2, basis, boundary=boundary, lmin=lmin)
    back = values(transform.dehierarchize(there, 2, basis, boundary=boundary, lmin=lmin))
    want = values(df)
    assert back.keys() == want.keys() and max(abs(back[k] - want[k]) for k in want) < 1e-12


def test_surplus_of_squares(spark):
    """The surplus of the product of squares is the product of -2^(-2l), the ends 0 and 1."""
    df = grids.described(transform.hierarchize(grid(spark, [(4, 3)], lambda x: x[0] * x[0] * x[1] * x[1]), 2))
    for r in df.collect():
        want = 1.0
        for c, l in zip(r["coords"], r["point_level"]):
            want *= c if l == 0 else -(2.0 ** (-2 * l))
        assert abs(r["value"] - want) < 1e-12


@pytest.mark.parametrize("basis", ["fullweighting", "biorthogonal"])
def test_mass_is_conserved(spark, basis):
    """Half the sum of the two end values at level 0 is the trapezoidal integral."""
    df = grid(spark, [(5,)], lambda x: F.exp(-x[0]) * F.cos(5 * x[0]))
    v = [r["value"] for r in df.orderBy(F.col("idx")[0]).collect()]
    mass = (sum(v) - 0.5 * (v[0] + v[-1])) / 32
    h = values(transform.hierarchize(df, 1, basis))
    assert abs(0.5 * (h[(0, (0,))] + h[(0, (32,))]) - mass) < 1e-12


def test_missing_and_repeated_points(spark):
    rows = [(1, 0, [0], 1.0), (1, 0, [0], 1.0), (1, 0, [1], float("nan")), (1, 0, [2], 3.0), (1, 0, [3], None), (1, 0, [4], 5.0), (None, 0, [0], 1.0), (1, 0, None, 1.0)]
    p = grids.clean(spark.createDataFrame(rows, "task_id bigint, field_id int, idx array<bigint>, value double"))
    assert p.count() == 5
    full = grids.with_levels(p, tasks(spark, [(0,), (2,)]))
    h = values(transform.hierarchize(full, 1))
    assert h[(1, (2,))] == 0.0 and h[(1, (1,))] is None and h[(1, (3,))] is None and h[(1, (4,))] == 5.0
    gone = full.where("idx[0] != 1")
    assert values(transform.hierarchize(gone, 1)) == h
    assert transform.hierarchize(full.where("false"), 1).count() == 0


def test_combination_reproduces_planes(spark):
    s = scheme.classical(spark, [2, 2], [5, 5]).collect()
    levels, coeffs = [tuple(r["level"]) for r in s], [r["coeff"] for r in s]
    t = tasks(spark, levels, coeffs)
    p = grids.filled(t, 2, lambda x: x[0] + 10 * x[1]).withColumn("top", L.vec([5, 5]))
    h = transform.hierarchize(p.select("task_id", "field_id", "idx", "value", "level"), 2)
    k = combine.keyed(h.join(t.select("task_id", "coeff"), "task_id").withColumn("top", L.vec([5, 5])))
    sg = combine.gather(k)
    assert sg.count() == 385
    back = transform.dehierarchize(combine.scatter(k, sg).select("task_id", "field_id", "idx", "value", "level"), 2)
    got, want = values(back), values(p)
    assert max(abs(got[x] - want[x]) for x in want) < 1e-12
    target = spark.createDataFrame([(0, [5, 5], [5, 5])], "task_id bigint, level array<int>, top array<int>")
    full = transform.dehierarchize(combine.onto(sg, target, 2).select("task_id", "field_id", "idx", "value", "level"), 2)
    assert max(abs(v - (i[1][0] + 10 * i[1][1]) / 32) for i, v in values(full).items()) < 1e-12
    sizes = combine.subspaces(k)
    assert sizes.where("NOT consistent").count() == 0 and sizes.agg(F.sum("n_points")).first()[0] == 385


def test_constant_grids(spark):
    """Grids that hold l0 / l1: the combined value in the middle is 4/3."""
    s = {(2, 4): 1.0, (3, 3): 1.0, (4, 2): 1.0, (2, 3): -1.0, (3, 2): -1.0}
    t = tasks(spark, list(s), list(s.values()))
    p = grids.indices(t, 2).withColumn("value", F.col("level")[0] / F.col("level")[1])
    mid = spark.createDataFrame([(1, [0.5, 0.5])], "pt_id bigint, coords array<double>")
    v = interp.combined(interp.at_points(p, t, mid, 2), t)
    assert abs(v.first()["value"] - 4 / 3) < 1e-12


@pytest.mark.parametrize("boundary", [0, 1, 2])
def test_interpolation(spark, boundary):
    f = (lambda x: F.sin(math.pi * x[0]) * F.sin(math.pi * x[1])) if boundary < 2 else grids.hyperplane
    p = grid(spark, [(3, 4)], f, boundary)
    probes = [[1 / math.sqrt(2), 1 / math.sqrt(3)], [0.5, 0.5 + 1e-4], [0.0, 0.0], [1.0, 1.0], [1.5, 0.2], [0.02, 0.98]]
    pts = spark.createDataFrame(list(enumerate(probes)), "pt_id bigint, coords array<double>")
    got = {r["pt_id"]: r["value"] for r in interp.at_points(p, tasks(spark, [(3, 4)]), pts, 2, boundary).collect()}
    assert got[4] == 0.0
    if boundary == 2:
        for k in (0, 1, 2, 3, 5):
            assert abs(got[k] - (1 + probes[k][0] + 2 * probes[k][1])) < 1e-12
    else:
        assert abs(got[2]) < 1e-12 and abs(got[3]) < 1e-12
        v = values(p)
        at = lambda i, j: 0.0 if i in (0, 8) or j in (0, 16) else v[(0, (i - 1, j - 1) if boundary == 0 else (i, j))]
        x, y = probes[5][0] * 8, probes[5][1] * 16
        want = sum(at(i, j) * (1 - abs(x - i)) * (1 - abs(y - j)) for i in (0, 1) for j in (15, 16))
        assert abs(got[5] - want) < 1e-12


def test_interpolation_without_values(spark):
    p = grid(spark, [(1, 1)], grids.hyperplane).withColumn("value", F.when(F.col("idx") != F.array(F.lit(2), F.lit(2)), F.col("value")))
    pts = spark.createDataFrame([(0, [0.25, 0.25]), (1, [0.75, 0.75]), (2, None), (3, [0.1])], "pt_id bigint, coords array<double>")
    got = {r["pt_id"]: r["value"] for r in interp.at_points(p, tasks(spark, [(1, 1)]), pts, 2).collect()}
    assert got == {0: 1.75, 1: None}


def test_extrapolation_without_boundary(spark):
    p = grid(spark, [(2, 2)], grids.hyperplane, 0)
    pts = spark.createDataFrame([(0, [0.1, 0.9])], "pt_id bigint, coords array<double>")
    got = interp.at_points(p, tasks(spark, [(2, 2)]), pts, 2, 0, extrapolate=True).first()["value"]
    assert abs(got - (1 + 0.1 + 1.8)) < 1e-12


def test_resample_and_add(spark):
    p = grid(spark, [(3, 2)], grids.hyperplane)
    r = values(interp.resampled(p, tasks(spark, [(3, 2)]), [2, 3], 2))
    assert max(abs(v - (1 + i[1][0] / 4 + 2 * i[1][1] / 8)) for i, v in r.items()) < 1e-12 and len(r) == 45
    base = grid(spark, [(2, 2)], grids.hyperplane).select("field_id", "idx", "value")
    total = interp.added_onto(base, p, tasks(spark, [(3, 2)]), [2, 2], 2, 2.0).collect()
    assert all(abs(x["value"] - 3 * (1 + x["idx"][0] / 4 + 2 * x["idx"][1] / 4)) < 1e-12 for x in total)
    wide = interp.added_onto(base, p, tasks(spark, [(3, 2)]), [2, 2], 2, 1.0, stretch_from=3).collect()
    x = next(x for x in wide if x["idx"] == [1, 2])
    assert abs(x["value"] - (1 + 0.25 + 1 + 1 + (0.25 + 0.5) / 2 + 1)) < 1e-12


def test_norms(spark):
    p = grid(spark, [(4, 3)], grids.hyperplane)
    one, two = norms.weighted(p, 1).first()["norm"], norms.l2_true(p).first()["norm"]
    assert norms.weighted(p, 0).first()["norm"] == 4.0 and abs(one - 2.5) < 1e-12
    assert one <= two <= 4.0 and norms.weighted(p, 2).first()["norm"] <= one
    assert abs(norms.serial(norms.normalized(p, 2)).first()["l2"] - 1) < 1e-12
    c = norms.compared(p, p, ["task_id", "idx"], normalize=True).first()
    assert c["diff_l0"] == 0 and abs(c["a_l2"] - 1) < 1e-12


def test_layers_and_boundaries(spark):
    p = grid(spark, [(2, 2)], grids.hyperplane, 1)
    wrapped = {tuple(r["idx"]): r["below"] for r in grids.neighbour(p, 0, periodic=True).collect()}
    v = values(p)
    assert all(wrapped[i] == v[(0, ((i[0] - 1) % 4, i[1]))] for i in wrapped)
    q = values(grids.lower_to_upper(grid(spark, [(2, 2)], grids.hyperplane), 1))
    assert all(q[(0, (i, 4))] == q[(0, (i, 0))] for i in range(5))


def test_advection_moves_mass_but_keeps_it(spark):
    assert stable([[3, 3]], 0.01) and not stable([[5, 5]], 0.1)
    p = grid(spark, [(3, 3)], grids.moving_gaussian, 1)
    a, b = values(p), values(advect(p, 2, 0.01))
    assert abs(sum(a.values()) - sum(b.values())) < 1e-12 and max(abs(a[k] - b[k]) for k in a) > 1e-3


def test_cuts():
    assert grids.default_cuts(10, 3) == [0, 4, 7]
    assert grids.downsampled_cuts([[0, 3, 14], [0], [0, 1]], [6, 5, 4], [1, 2, 4]) == [[0, 1, 1], [0], [0, 1]]
    assert combine.chunks([([1], 5), ([2], 5), ([3], 20), ([4], 1)], 10) == [[[1], [2]], [[3]], [[4]]]
    assert combine.reduced_top([2, 2], [5, 3], [1, 2]) == [4, 2]


def test_complex_and_stable_sum(spark):
    p = spark.createDataFrame([(1, 0, [0], (3.0, 4.0)), (1, 1, [0], (1.0, None))], "task_id bigint, field_id int, idx array<bigint>, value struct<re:double,im:double>")
    back = numbers.as_complex(numbers.as_fields(p), ["task_id", "idx"])
    assert sorted((r["field_id"], tuple(r["value"])) for r in back.collect()) == [(0, (3.0, 4.0)), (1, (1.0, None))]
    assert p.select(numbers.modulus(F.col("value"))).first()[0] == 5.0
    d = spark.createDataFrame([(0.1,)] * 1000 + [(1e6,), (-1e6,)], "v double")
    assert abs(d.agg(numbers.stable_sum(F.col("v"))).first()[0] - 100) < 1e-9


def test_missing_points_of_a_pole(spark):
    """Points missing from a pole are found by their index, once each, and count as null or as a given value."""
    t = spark.createDataFrame([(0, 0, [i, 0], float(i), [2, 0]) for i in (0, 1, 4, 4)] + [(0, 0, [i, 1], 1.0, [2, 0]) for i in range(5)], "task_id bigint, field_id int, idx array<bigint>, value double, level array<int>")
    got = values(transform.along(t, 0, lmin=2))
    assert [got[0, (i, 0)] for i in range(5)] == [0.0, 1.0, None, None, 4.0] and len(got) == 10
    got = values(transform.along(t, 0, lmin=2, missing=0.0))
    assert [got[0, (i, 0)] for i in range(5)] == [0.0, 1.0, 0.0, 0.0, 4.0]


def test_on_top_needs_no_join(spark):
    """The sparse grid on its reference grid: as scattered onto all points, and without a join, whose sides would look small enough to be broadcast."""
    s = spark.createDataFrame([(1, 0, [2, 3], 1.0), (1, 1, [3, 2], 1.0), (1, 2, [2, 2], -1.0), (None, 3, [1, 1], 1.0)], "scheme_id bigint, task_id bigint, level array<int>, coeff double")
    s = combine.with_top(s, ["scheme_id"], 2).withColumn("field_id", F.lit(0))
    k = combine.keyed(transform.hierarchize(grids.filled(s, 2, grids.cosine_product), 2, keep=["scheme_id", "coeff", "top"]))
    sg = combine.gather(k, ["scheme_id", "top"]).withColumn("task_id", F.col("scheme_id"))
    out = combine.on_top(sg, 2)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = values(out)
    target = s.where("scheme_id = 1").select("scheme_id", F.col("scheme_id").alias("task_id"), "top", F.col("top").alias("level")).distinct()
    want = values(transform.dehierarchize(combine.onto(sg.drop("task_id", "top"), target, 2, ["scheme_id"]).select("task_id", "field_id", "idx", "value", "level"), 2))
    assert len(want) == 81 and {p for p in got if p[0] is None} == {(None, (i, j)) for i in range(3) for j in range(3)}
    assert all(abs(got[p] - v) < 1e-12 for p, v in want.items())


def test_corners_are_looked_up_once_a_cell(spark):
    """However many points lie in a cell, its corners are looked up once; a point with a missing coordinate has no value."""
    p = grid(spark, [(1, 1), (2, 1)], grids.paraboloid)
    t = tasks(spark, [(1, 1), (2, 1)])
    pts = interp.random_points(spark, 500, 2, seed=3)
    placed = interp._placed(interp._on_all(pts, t, 2), 2)
    assert placed.count() == 1000 and interp._cells(p, t, placed, 2).count() == 4 + 8
    plan = interp.at_points(p, t, pts, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Generate posexplode" in x and "pt_id" in x]
    odd = spark.createDataFrame([(0, [None, 0.5]), (1, [0.25, 0.5]), (2, [-1.0, 0.5])], "pt_id bigint, coords array<double>")
    got = {r["pt_id"]: r["value"] for r in interp.at_points(p, t, odd, 2).where("task_id = 0").collect()}
    assert got[0] is None and got[1] is not None and got[2] == 0.0


def _with_gaps(spark):
    """Two schemes of grids with points without a value, and points inside, on lines of grids and outside."""
    levels = [(1, 3), (2, 2), (3, 1), (1, 2), (2, 1), (2, 2)]
    s = spark.createDataFrame([(1, i, c) for i, c in enumerate([1.0, 1.0, 1.0, -1.0, -1.0])] + [(2, 0, 2.0), (2, 5, None), (None, 5, 1.0)], "scheme_id bigint, task_id bigint, coeff double")
    p = grid(spark, levels, grids.cosine_product)
    p = p.unionByName(p.withColumn("field_id", F.lit(1)).withColumn("value", F.when(F.hash("task_id", "idx") % 23 != 0, F.col("value") + 1)))
    xs = [0.0, 0.0625, 0.125, 0.3, 0.5, 0.75, 0.8, 1.0, 1.5]
    pts = spark.createDataFrame([(i * 9 + j, [x, y]) for i, x in enumerate(xs) for j, y in enumerate(xs)], "pt_id bigint, coords array<double>")
    return p, tasks(spark, levels), s, pts


def test_combined_at_the_finest_grid(spark):
    """As the sum over the grids at each point, missing values too."""
    p, t, s, pts = _with_gaps(spark)
    rows = lambda df: {(r["scheme_id"], r["pt_id"], r["field_id"]): None if r["value"] is None else round(r["value"], 9) + 0.0 for r in df.collect()}
    want = rows(interp.combined(interp.at_points(p, t, pts, 2), s, ["scheme_id"]))
    got = rows(interp.combined_at(p, t, s, pts.withColumn("x", F.get("coords", F.lit(0))), 2, ["scheme_id"]))
    assert got == want and len(want) == 3 * 81 * 2
    assert 20 < sum(v is None for k, v in want.items() if k[2] == 1) < 200


def test_fields_summed_at(spark):
    p, t, s, pts = _with_gaps(spark)
    v = interp.combined(interp.at_points(p, t, pts, 2), s, ["scheme_id"])
    plain = lambda df: {(r["scheme_id"], r["pt_id"], r["systems"]): None if r["value"] is None else round(r["value"], 9) + 0.0 for r in df.collect()}
    from dyadica.operators.stats import systems_sum

    assert plain(interp.fields_summed_at(p, t, s, pts, 2, ["scheme_id"])) == plain(systems_sum(v.where("field_id = 0"), v.where("field_id = 1"), by=["scheme_id"]))


def test_moments_and_errors_without_a_join(spark):
    p, t, s, pts = _with_gaps(spark)
    v = interp.combined_at(p, t, s, pts.withColumns({"x0": F.get("coords", F.lit(0)), "x1": F.get("coords", F.lit(1))}), 2, ["scheme_id"]).where("scheme_id = 1 AND field_id = 0").cache()
    x = [F.col("x0"), F.col("x1")]
    assert all(abs(a - b) < 1e-12 for a, b in zip(interp.moments(v, x, 2).first(), interp.moments(v, pts, 2).first()))
    exact = pts.select("pt_id", grids.hyperplane([F.get("coords", F.lit(0)), F.get("coords", F.lit(1))]).alias("value"))
    assert all(abs(a - b) < 1e-12 for a, b in zip(interp.mc_errors(v, grids.hyperplane(x)).first(), interp.mc_errors(v, exact).first()))


def test_round_trip_deviations_without_a_join(spark):
    """A point or value that is missing counts as a deviation of 9, and no grid is joined."""
    from dyadica.plans.reference import deviations

    p = grid(spark, [(2, 1), (1, 1), (2, 2)], grids.hyperplane).where("task_id <> 1 OR idx[0] <> 1").withColumn("value", F.when(~((F.col("task_id") == 2) & (F.get("idx", F.lit(0)) == 0)), F.col("value")))
    df = deviations(p, grids.hyperplane, 2)
    assert {r["task_id"]: r["deviation"] for r in df.collect()} == {0: 0.0, 1: 9.0, 2: 9.0}
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
