from __future__ import annotations

import datetime as dt
import random

import pytest

from dyadica.llm import quantiles
from dyadica.llm.quantiles import ERROR, LEVELS, bucket, merged, middle, percentiles, readings, select_ranks, summaries
from pyspark.sql import functions as F

SCHEMA = "task_id bigint, duration_us bigint, group_no int, stat_id bigint, logged_at timestamp, key string, day string"


def rows(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = rng.choice([0, -1, 9223372036854775807, -9223372036854775808, rng.randrange(1, 2000), int(10 ** rng.uniform(0, 18)), 77])
        day = dt.datetime(2031, 3, 1 + rng.randrange(4), rng.randrange(24))
        out.append((rng.choice([1, 1, 1, 2, 3, None]), v if rng.random() > 0.02 else None, rng.choice([0, 0, 5, -1, None]), i if rng.random() > 0.02 else None, day if rng.random() > 0.02 else None, "x", "y"))
    return out


def exact(data):
    groups, seen = {}, set()
    for task, v, g, sid, *_ in data:
        if v is None or (sid is not None and sid in seen):
            continue
        seen.add(sid)
        if task is not None:
            groups.setdefault(("task", task), []).append(v)
        if g is not None and g != -1:
            groups.setdefault(("group", g), []).append(v)
    return {k: {q: sorted(v)[-(-m * len(v) // 1000) - 1] for q, m in LEVELS.items()} | {"n": len(v)} for k, v in groups.items()}


def close(a, b):
    return abs(a - b) <= abs(b) * ERROR


def check(got, want):
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k]["n"] == w["n"]
        for q in LEVELS:
            assert close(got[k][q], w[q]), (k, q, got[k][q], w[q])


def table(df):
    return {(r["scope"], r["key"]): r.asDict() for r in df.collect()}


def test_buckets(spark):
    values = [0, 1, -1, 511, 512, 513, 1023, 1024, 1025, 2047, 2048, -5000, 10**9 + 7, 2**53 + 1, 2**62, 2**63 - 1, -(2**63), -(2**63) + 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("b", bucket("v")).withColumn("m", middle("b"))
    got = {r["v"]: (r["b"], r["m"]) for r in df.collect()}
    assert all(close(m, v) for v, (_, m) in got.items()) and all(got[v][1] == v for v in values if abs(v) < 1024)
    assert [b for _, (b, _) in sorted(got.items())] == sorted(b for b, _ in got.values())


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_percentiles_within_error(spark, monkeypatch, parts):
    monkeypatch.setattr(quantiles, "PARTS", parts)
    data = rows(3000)
    data += random.Random(1).sample(data, 200)
    data = [(*r[:3], r[3] if r[3] is not None else None, *r[4:]) for r in data]
    named = [r for r in data if r[3] is not None]
    check(table(percentiles(spark.createDataFrame(named, SCHEMA))), exact(named))


def test_unnamed_readings_count_each(spark):
    data = [(1, 10, 0, None, None, "x", "y")] * 3 + [(1, 99, 0, 1, None, "x", "y")] * 3
    got = table(percentiles(spark.createDataFrame(data, SCHEMA)))
    assert got[("task", 1)]["n"] == 4 and got[("task", 1)]["p50"] == 10 and got[("group", 0)]["p90"] == 99


def test_days_can_be_joined(spark):
    """The summaries of separate days, joined, are those of all days, and so are the percentiles."""
    data = [r for r in rows(1500, 7) if r[3] is not None]
    once = readings(spark.createDataFrame(data, SCHEMA)).cache()
    whole = summaries(once)
    days = [once.where(F.col("day").eqNullSafe(F.lit(r["day"]))) for r in once.select("day").distinct().collect()]
    joined = merged(*[summaries(d) for d in days])
    assert joined.exceptAll(whole).count() == 0 and whole.exceptAll(joined).count() == 0
    check(table(select_ranks(joined)), exact(data))


def test_hot_group_and_ties(spark):
    data = [(1, 5, 0, i, None, "x", "y") for i in range(2000)] + [(2, 7, 0, 5000, None, "x", "y")]
    got = table(percentiles(spark.createDataFrame(data, SCHEMA)))
    assert [got[("group", 0)][q] for q in LEVELS] == [5] * 5 and got[("task", 2)]["p999"] == 7


def test_empty(spark):
    assert percentiles(spark.createDataFrame([], SCHEMA)).count() == 0
