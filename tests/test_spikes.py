from __future__ import annotations

import random

import numpy as np
import pytest

from dyadica.operators import spikes
from dyadica.operators.spikes import SpikeRules, implausible, robust_components, spikes_of

SCHEMA = "task_id bigint, stat_id bigint, duration_us bigint, sim_time double, n_procs int, id string, src string"


def series(n=200, seed=0, size=1e6, scatter=0.05, drift=0.3):
    rng = np.random.default_rng(seed)
    return np.round(size * np.exp(drift * np.arange(n) / n + scatter * rng.standard_normal(n)))


def test_components_split_off_sparse_part():
    rng = np.random.default_rng(1)
    low = np.outer(3 * rng.standard_normal(60), np.ones(10)) + np.outer(rng.standard_normal(60), np.linspace(-0.03, 0.03, 10))
    noisy = low + 0.01 * rng.standard_normal(low.shape)
    noisy[7, 3] += 5.0
    noisy[40, 9] -= 4
    back, aside, _ = robust_components(noisy, 2, 4.0)
    assert abs(back - low).max() < 0.1
    assert aside[7, 3] and aside[40, 9] and aside.sum() < 5


@pytest.mark.parametrize("seed", range(5))
def test_spikes_found_and_no_others(seed):
    v = series(seed=seed)
    v[[0, 50, 120, 199]] *= [3, 0.2, 2, 4]
    found = np.flatnonzero(spikes_of(v, np.full(len(v), 8.0)))
    assert found.tolist() == [0, 50, 120, 199]


def test_change_of_level_and_of_processes_is_no_spike():
    v = series()
    v[90:] *= 2.5
    assert not spikes_of(v, np.full(len(v), 8.0)).any()
    procs = np.where(np.arange(len(v)) < 90, 8.0, 16.0)
    procs[[10, 89, 90, 150]] = np.nan
    assert not spikes_of(v, procs).any()
    v[140] *= 3
    assert np.flatnonzero(spikes_of(v, procs)).tolist() == [140]


def course(n=240, seed=2):
    """A course that spans much more than its scatter, with spikes that lie inside the span."""
    rng = np.random.default_rng(seed)
    y = 12 + 1.5 * np.sin(np.arange(n) / 25) + 0.02 * rng.standard_normal(n)
    at = [20, 90, 91, 160, 215]
    y[at] += [0.4, -0.5, -0.5, 0.4, -0.4]
    return np.round(np.exp(y)), at


def test_components_decide(monkeypatch):
    """With a constant level in the place of the low-rank part the spikes of a course aren't found."""
    v, at = course()
    setting = np.full(len(v), 8.0)
    assert np.flatnonzero(spikes_of(v, setting)).tolist() == at
    monkeypatch.setattr(spikes, "robust_components", lambda m, rank, candidate: (np.full(m.shape, np.median(m)), np.zeros(m.shape, bool), np.zeros(m.shape[1])))
    assert not set(at) & set(np.flatnonzero(spikes_of(v, setting)))


@pytest.mark.parametrize("where", [1, 2, 70, 194, 196])
def test_bursts_of_three(where):
    v = series(scatter=0.03)
    v[where : where + 3] *= 2.5
    assert np.flatnonzero(spikes_of(v, np.full(len(v), 8.0))).tolist() == [where, where + 1, where + 2]


@pytest.mark.parametrize("where", [5, 7, 192, 195])
def test_change_of_level_near_an_end(where):
    v = series(scatter=0.03)
    v[:where] *= 2.5
    assert not spikes_of(v, np.full(len(v), 8.0)).any()


def test_normal_readings_are_no_spikes():
    rng = np.random.default_rng(7)
    found = sum(spikes_of(np.round(np.exp(14 + 0.05 * rng.standard_normal(60))), np.full(60, 4.0)).sum() for _ in range(300))
    assert found == 0  # of 18000


def test_coarse_clock():
    v = np.round(series(scatter=0.002, drift=0.0) / 1e5) * 1e5
    assert not spikes_of(v, np.full(len(v), 8.0)).any()


def rows_of(values, task=1, start=0):
    return [(task, start + i, None if v is None else int(v), (i + 1) * 0.5, 8, "x", "y") for i, v in enumerate(values)]


@pytest.mark.parametrize("floor", [1 << 20, 50])
def test_operator(spark, floor):
    v = series(400)
    v[33] *= 5
    v[200:206] = v[200]
    rows = rows_of(v)
    rows[77] = (1, 77, -5, 39.0, 8, "x", "y")
    rows[78] = (1, 78, 1_000_000, float("nan"), 8, "x", "y")
    rows[79] = (1, 79, None, 40.0, None, "x", "y")
    rows[203] = (1, 203, None, 102.0, 8, "x", "y")
    rows += [rows[33], rows[5], (None, 900, 0, 1.0, 8, "x", "y"), (None, 901, 7, 1.0, 8, "x", "y"), (2, 902, 5, None, None, "x", "y"), (1, None, -1, 1.0, 8, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["stat_id"]: (r["impossible"], r["spike"], r["stuck"]) for r in implausible(df, floor=floor).collect()}
    stuck = {200, 201, 202, 204, 205}
    assert set(got) == {33, 77, 78, 900} | stuck
    assert got[33] == (False, True, False) and got[77][0] and got[78][0] and got[900][0]
    assert all(got[s][2] for s in stuck)


def many(n=1500):
    v = series(n, seed=4)
    v[[99, 100, 450, 799, 800, 1499]] *= 4
    v[596:604] = v[596]
    rows = rows_of(v) + rows_of(series(60, 9), 2, 5000)
    lost = random.Random(5)
    out = []
    for t, i, d, st, p, *rest in rows:
        k = lost.random()
        out.append((t, i, None if k < 0.02 else d, None if 0.02 < k < 0.06 else st, None if 0.06 < k < 0.1 else p, *rest))
    return out


def of(df, **kw):
    return sorted(map(tuple, implausible(df, SpikeRules(), **kw).collect()))


@pytest.mark.parametrize("stretch, overlap", [(1 << 13, 1 << 9), (128, 40)])
def test_batches_and_blocks_change_nothing(spark, monkeypatch, stretch, overlap):
    monkeypatch.setattr(spikes, "STRETCH", stretch)
    monkeypatch.setattr(spikes, "OVERLAP", overlap)
    df = spark.createDataFrame(many(), SCHEMA)
    one = of(df)
    assert {r[0] for r in one if r[2]} <= {99, 100, 450, 799, 800, 1499}
    assert len([r for r in one if r[2]]) >= 5 and len([r for r in one if r[3]]) >= 5
    for size in ("50", "700"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert of(df) == one
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for floor in (40, 400):
        assert of(df, floor=floor) == one


def test_scatter_is_that_of_the_whole_source(spark):
    """A source whose scatter grows near its end is judged alike in whatever company it is."""
    rng = np.random.default_rng(8)
    n = 9000
    v = np.round(np.exp(14 + np.where(np.arange(n) > n - 400, 0.3, 0.03) * rng.standard_normal(n)))
    alone = of(spark.createDataFrame(rows_of(v), SCHEMA))
    both = of(spark.createDataFrame(rows_of(v) + rows_of(series(50_000, 3), 2, 100_000), SCHEMA).coalesce(1), floor=5000)
    assert alone == [r for r in both if r[0] < 100_000]


def test_runs_across_blocks(spark):
    """Runs of equal values wherever the limits of blocks fall, with readings between them that are passed over."""
    v = series(600, 6)
    for k in range(5, 600, 23):
        v[k : k + 5 + k % 4] = v[k]
    rows = rows_of(v)
    rows[7] = (*rows[7][:2], None, *rows[7][3:])
    df = spark.createDataFrame(rows, SCHEMA)
    one = of(df)
    assert sum(r[3] for r in one) > 130
    for floor in (15,):
        assert of(df, floor=floor) == one


def test_empty(spark):
    assert implausible(spark.createDataFrame([], SCHEMA)).count() == 0
