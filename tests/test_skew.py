from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dyadica.operators import skew
from dyadica.operators.skew import hot_keys, lookup_join, numbered, with_blocks

SCHEMA = "k string, v bigint"


def rows(n=600, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "warm", f"k{rng.randrange(50)}", None]), rng.choice([rng.randrange(1000), None, 5])) for _ in range(n)]


def test_hot_keys_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert {r["k"] for r in hot_keys(df, ["k"], 100)} == {"hot", "warm"}
    assert hot_keys(df, ["k"], 10_000) == []
    monkeypatch.setattr(skew, "MAX_HOT", 2)  # at least half of all rows
    assert hot_keys(df, ["k"], 1) == []


@pytest.mark.parametrize("floor", [1, 50, 10_000])
def test_lookup_join(spark, floor):
    left = spark.createDataFrame(rows(), SCHEMA)
    right = spark.createDataFrame([("hot", 1), ("warm", 2), ("k3", 3), ("never", 4)], "k string, w int")
    want = sorted(left.join(right, "k", "left").select("k", "v", "w").collect(), key=repr)
    assert sorted(lookup_join(left, right, ["k"], floor).select("k", "v", "w").collect(), key=repr) == want


def test_blocks_are_ordered_and_whole(spark):
    df = spark.createDataFrame(rows(2000), SCHEMA)
    out, hot = with_blocks(df, ["k"], "v", floor=100)
    assert hot and out.count() == 2000
    assert out.where("k NOT IN ('hot', 'warm') AND _blk != 0").count() == 0
    b = out.where("k = 'hot' AND v IS NOT NULL").groupBy("_blk").agg(F.min("v").alias("a"), F.max("v").alias("z"), F.count("v").alias("n")).orderBy("_blk").collect()
    assert len(b) > 2 and all(x["z"] < y["a"] for x, y in zip(b, b[1:]))
    same, hot = with_blocks(df, ["k"], "v", floor=10_000)
    assert not hot and same.where("_blk != 0").count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([(random.Random(3).randrange(10**6) + i, i) for i in range(500)], "a bigint, b bigint").repartition(5)
    got = sorted((r["b"], r["n"]) for r in numbered(df, [F.desc("b")], "n", 1).collect())
    assert got == [(i, 500 - i) for i in range(500)]
    assert numbered(df.where("false"), ["b"], "n").count() == 0
