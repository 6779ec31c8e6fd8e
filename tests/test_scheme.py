from __future__ import annotations

import itertools
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dyadica.functions import levels as L
from dyadica.operators import scheme


def dof(spark, lmin, lmax, boundary=2):
    return scheme.sparse_dof(scheme.truncated_levels(spark, lmin, lmax), boundary).first()["dof"]


def test_known_sizes(spark):
    assert [dof(spark, [1], [5]), dof(spark, [1, 1], [2, 2]), dof(spark, [1] * 3, [3] * 3)] == [33, 21, 225]
    assert [dof(spark, [2] * 4, [7] * 4, b) for b in (0, 1, 2)] == [81921, 141312, 222209]


@pytest.mark.parametrize("levels,cuts,want", [(([1], [5]), [[0, 1]], [1, 32]), (([1, 1], [2, 2]), [[0, 1], [0, 3]], [3, 10, 2, 6]), (([1] * 3, [3] * 3), [[0, 1], [0, 2], [0, 3]], [4, 16, 13, 46, 8, 30, 24, 84])])
def test_partitioned_dof(spark, levels, cuts, want):
    df = scheme.partitioned_dof(scheme.truncated_levels(spark, *levels), levels[1], cuts)
    assert [r["dof"] for r in df.orderBy("part").collect()] == want


@pytest.mark.parametrize("lmin,lmax,grids", [([2, 2], [5, 5], 7), ([3] * 3, [7] * 3, 31), ([2] * 4, [4] * 4, 15), ([2, 2], [4, 4], 5)])
def test_classical_is_adaptive(spark, lmin, lmax, grids):
    a = {tuple(r["level"]): r["coeff"] for r in scheme.classical(spark, lmin, lmax).collect()}
    b = {tuple(r["level"]): r["coeff"] for r in scheme.adaptive(spark, lmin, lmax).collect()}
    assert a == b and len(a) == grids and sum(a.values()) == 1


@pytest.mark.parametrize("lmin,lmax,grids", [([2, 4], [9, 9], 11), ([2, 3, 4], [7, 7, 7], 10)])
def test_adaptive(spark, lmin, lmax, grids):
    a = scheme.adaptive(spark, lmin, lmax).collect()
    assert len(a) == grids and sum(r["coeff"] for r in a) == 1


def test_fixed_dimension_and_faults(spark):
    s = {tuple(r["level"]): r["coeff"] for r in scheme.classical(spark, [2, 3, 2], [4, 3, 4]).collect()}
    assert all(l[1] == 3 for l in s) and len(s) == 5 and sum(s.values()) == 1
    ft = {tuple(r["level"]): r["coeff"] for r in scheme.classical(spark, [2, 2], [5, 5], True).collect()}
    assert sum(c == 0 for c in ft.values()) == 3 and {sum(l) for l, c in ft.items() if c == 0} == {4, 5}
    assert [tuple(r) for r in scheme.classical(spark, [2, 2], [2, 2]).collect()] == [([2, 2], 1.0)]
    with pytest.raises(ValueError):
        scheme.classical(spark, [3], [2])


def test_json(spark, tmp_path):
    p = str(tmp_path / "s.json")
    rows = [{"coeff": 1.0, "level": [3, 4], "group_no": 0}, {"coeff": -1.0, "level": [3, 3], "group_no": 1}]
    open(p, "w").write(json.dumps(rows))
    assert scheme.from_json(spark, p, [3, 3], [4, 4]).count() == 2
    with pytest.raises(ValueError):
        scheme.from_json(spark, p, [3, 4], [4, 4])
    open(p, "w").write(json.dumps([rows[0], {"coeff": 1.0, "level": [3, 3]}]))
    with pytest.raises(ValueError):
        scheme.from_json(spark, p)


def test_active_sets(spark):
    assert scheme.diagonal_set([1, 1], [3, 3]) == {(1, 3), (2, 2), (3, 1)}
    assert scheme.root_set([1, 1], [3, 4]) == {(1, 1), (3, 1), (1, 4)}
    assert scheme.extra_diagonals([1, 1], [4, 4]) == {(1, 1), (1, 2), (2, 1)}
    assert len(scheme.thinned_set([1, 1], [5, 5], 2)) == 3
    spanned = {tuple(r["level"]): r["coeff"] for r in scheme.spanned(spark, scheme.diagonal_set([0, 0], [3, 3])).collect()}
    assert sum(spanned.values()) == 1
    assert scheme.nearest_neighbours([(1, 1), (1, 2), (5, 5)], 1)[(5, 5)] == [(1, 2)]
    assert len(scheme.k_subsets(2, 4)) == 6


def test_load_balance_and_split(spark):
    s = scheme.classical(spark, [2, 2], [5, 5]).withColumn("task_id", F.monotonically_increasing_id())
    s = spark.createDataFrame([(i, *r) for i, r in enumerate(map(tuple, s.select("level", "coeff").orderBy("level").collect()))], "task_id bigint, level array<int>, coeff double")
    out = scheme.load_balanced(s, 3)
    loads = [r[1] for r in scheme.combi_dof(out).groupBy("group").agg(F.sum("dof")).collect()]
    assert out.count() == 7 and max(loads) - min(loads) <= 99
    assert [r["system"] for r in scheme.split(s, [0.5, 0.5]).orderBy("task_id").collect()] == [0] * 4 + [1] * 3
    assert scheme.split(s.where("false"), [0.5, 0.5]).count() == 0


@given(st.lists(st.integers(1, 6), min_size=1, max_size=4), st.lists(st.integers(1, 6), min_size=1, max_size=4))
@settings(max_examples=15, deadline=None)
def test_partial_order(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    got = df.select(L.leq(F.col("a"), F.col("b")), L.total(F.col("a"))).first()
    assert got[0] == (all(x <= y for x, y in zip(a, b)) if len(a) == len(b) else None)
    assert got[1] == sum(a)


def test_box_below(spark):
    df = spark.createDataFrame([([2, 3],)], "level array<int>")
    assert sorted(map(tuple, df.select(scheme.box_below(F.col("level"))).first()[0])) == list(itertools.product(range(1, 3), range(1, 4)))
