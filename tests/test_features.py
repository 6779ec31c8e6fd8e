from __future__ import annotations

import random

from dyadica.operators.features import UNKNOWN, apply_deltas, spelled, timer_deltas, wide
from dyadica.streaming import features as store_module
from dyadica.streaming.features import DELTAS, FeatureStore
from pyspark.sql import functions as F

EVENTS = "rank int, grp int, event string, t_start_us bigint, t_end_us bigint, flushed_at string, own int"


def test_spelled(spark):
    df = spark.createDataFrame([("  Norm_L2  Field 3",), ("norm-l2 field 3",), (None,)], "e string")
    assert [r[0] for r in df.select(spelled(F.col("e"))).collect()] == ["norm l2 field 3", "norm l2 field 3", None]


def build(spark, events):
    types = spark.createDataFrame([(1, "solve step"), (2, "Write Grid"), (None, "x"), (3, None)], "event_type_id int, event string")
    attributes = spark.createDataFrame([(0, 7, " TRUE"), (1, 7, "0"), (2, 8, None), (3, 9, "1")], "rank int, grp int, group_manager string")
    deltas, survivors = timer_deltas(spark.createDataFrame(events, EVENTS), attributes, types)
    state = apply_deltas(None, deltas, survivors)
    groups = attributes.select(F.col("grp").alias("entity"))
    return {r["grp"]: r for r in wide(state, groups, [1, 2], "grp").collect()}


def test_table(spark):
    events = [
        (0, 7, "solve_step", 0, 10, "a", 1),
        (0, 7, "solve_step", 0, 10, "b", 1),  # sent twice
        (0, None, "SOLVE STEP", 20, 50, "a", 1),
        (1, -1, "write grid", 30, 45, "a", 1),
        (None, 8, "write  grid", 5, 6, "a", 1),
        (2, 8, "what", 0, 100, "a", 1),
        (1, 7, "solve step", 9, 9, "a", 1),
        (1, 7, "solve step", 9, None, "a", 1),
        (5, None, "solve step", 0, 3, "a", 1),
    ]
    t = build(spark, events)
    assert set(t) == {7, 8, 9}
    assert (t[7]["n_1"], t[7]["total_1"], t[7]["since_1"], t[7]["n_mgr_1"], t[7]["total_mgr_1"], t[7]["since_mgr_1"]) == (2, 40, 0, 2, 40, 0)
    assert (t[7]["n_2"], t[7]["total_2"], t[7]["since_2"], t[7]["n_mgr_2"], t[7]["since_mgr_2"]) == (1, 15, 5, 0, None)
    assert (t[8]["n_2"], t[8]["since_2"], t[8]["latest_end_us"]) == (1, 94, 100)
    assert (t[9]["n_1"], t[9]["since_1"], t[9]["latest_end_us"]) == (0, None, None)


def test_empty(spark):
    assert all(r["n_1"] == 0 and r["latest_end_us"] is None for r in build(spark, []).values())


def test_deltas_against_recount(spark, tmp_path, monkeypatch):
    """Random inserts and retractions in batches give what counting the surviving events gives."""
    rng = random.Random(3)
    monkeypatch.setattr(store_module, "COMPACT", 2)
    alive = []
    for batch in range(4):
        store = FeatureStore(spark, str(tmp_path))  # opened anew, as after a restart
        if batch == 2:  # a state that was being written when the application ended, and a log
            (tmp_path / "state-2").mkdir()
            (tmp_path / "batch-2").mkdir()
        deltas = []
        for _ in range(60):
            e = (rng.randrange(3), rng.choice([1, 2, UNKNOWN]), rng.randrange(1, 9), rng.randrange(100), rng.random() < 0.3)
            alive.append(e)
            deltas.append((e[0], e[1], 1, *e[2:]))
        for e in sorted(alive, key=lambda e: -e[3])[:25]:  # the latest go first
            alive.remove(e)
            deltas.append((e[0], e[1], -1, *e[2:]))
        store.put(spark.createDataFrame(deltas, DELTAS), batch)
        store.put(spark.createDataFrame(deltas, DELTAS), batch)  # run again after a failure
        want = {}
        for g, t, length, end, f in alive:
            w = want.setdefault((g, t), [0, 0, 0, 0, -1, None])
            w[0] += 1
            w[1] += length
            w[4] = max(w[4], end)
            if f:
                w[2] += 1
                w[3] += length
                w[5] = end if w[5] is None else max(w[5], end)
        got = {(r["entity"], r["type_id"]): [r["n"], r["total"], r["n_f"], r["total_f"], r["last"], r["last_f"]] for r in store.state().collect()}
        assert got == want
        assert sum(r["weight"] for r in store.survivors().collect()) == len(alive)
    assert store.base is not None and len(list(tmp_path.glob("state-*"))) == 2 and len(list(tmp_path.glob("batch-*"))) < 3


def test_stream_of_deltas(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, 1, 5, 10, True), (1, 1, 1, 7, 30, False), (2, 1, 1, 1, 4, False)], DELTAS).write.parquet(src)
    store = FeatureStore(spark, str(tmp_path / "store"))
    store.follow(spark.readStream.schema(DELTAS).parquet(src), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["entity"], r["n"], r["total"], r["last"], r["last_f"]) for r in store.state().collect()) == [(1, 2, 12, 30, 10), (2, 1, 1, 4, None)]
    again = FeatureStore(spark, str(tmp_path / "store"))
    spark.createDataFrame([(1, 1, -1, 7, 30, False), (3, 1, 1, 2, 9, None)], DELTAS).write.mode("append").parquet(src)
    again.follow(spark.readStream.schema(DELTAS).parquet(src), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["entity"], r["n"], r["total"], r["last"], r["last_f"]) for r in again.state().collect()) == [(1, 1, 5, 10, 10), (2, 1, 1, 4, None), (3, 1, 2, 9, None)]


def test_empty_batch(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    store.put(spark.createDataFrame([], DELTAS), 5)
    assert store.state().count() == 0 and FeatureStore(spark, str(tmp_path)).version == 5
