from __future__ import annotations

import random

import pytest

from dyadica.operators.intervals import gaps, periods

SCHEMA = "rank int, t_start_us bigint, t_end_us bigint, _s string, gap string"


def brute(rows):
    """Periods and gaps by sweeping each rank's sorted rows."""
    by = {}
    for r, s, e, *_ in rows:
        if None not in (r, s, e) and e > s:
            by.setdefault(r, []).append((s, e))
    per, gap = [], []
    for r, xs in by.items():
        xs.sort()
        a, b, n = xs[0][0], xs[0][1], 0
        for s, e in xs:
            if s > b:
                per.append((r, a, b, n))
                gap.append((r, b, s))
                a, b, n = s, e, 0
            b, n = max(b, e), n + 1
        per.append((r, a, b, n))
    return sorted(per), sorted(gap)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("floor", [1 << 20, 20])
def test_against_sweep(spark, floor):
    rng = random.Random(5)
    rows = []
    for _ in range(1500):
        s = rng.randrange(0, 5000)
        rows.append((rng.choice([1, 1, 1, 2, 3, 4]), s, s + rng.choice([0, 1, 2, 5, 30, 400, -7])))
    rows += [(1, 0, 20_000), (9, 10, 11), (None, 1, 5), (2, None, 5), (2, 5, None), (5, -100, -50), (5, -50, 3)]
    rows += rows[:50]
    per, gap = brute(rows)
    df = frame(spark, rows)
    assert sorted(map(tuple, gaps(df, ["rank"], "t_start_us", "t_end_us", floor=floor).collect())) == gap
    assert sorted(map(tuple, periods(df, ["rank"], "t_start_us", "t_end_us", floor=floor).collect())) == per


@pytest.mark.parametrize("floor", [1 << 20, 10])
def test_sparse_hot_key_with_long_interval(spark, floor):
    rows = [(1, 10 * i, 10 * i + 3) for i in range(300)] + [(1, 500, 1234), (1, 1500, 1501)]
    per, gap = brute(rows)
    df = frame(spark, rows)
    assert sorted(map(tuple, gaps(df, ["rank"], "t_start_us", "t_end_us", floor=floor).collect())) == gap
    assert sorted(map(tuple, periods(df, ["rank"], "t_start_us", "t_end_us", floor=floor).collect())) == per


def test_huge_durations_and_touching(spark):
    big = 9_000_000_000_000_000_000
    df = frame(spark, [(1, 0, big), (2, 0, 5), (2, 5, 9), (2, 9, 10)])
    assert gaps(df, ["rank"], "t_start_us", "t_end_us").count() == 0
    assert sorted(map(tuple, periods(df, ["rank"], "t_start_us", "t_end_us").collect())) == [(1, 0, big, 1), (2, 0, 10, 3)]


def test_empty(spark):
    df = frame(spark, [])
    assert gaps(df, ["rank"], "t_start_us", "t_end_us").count() == 0
    assert periods(df, ["rank"], "t_start_us", "t_end_us").count() == 0
