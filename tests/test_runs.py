from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dyadica.operators import combine, faults, grids, interp, scheme, sched, stats
from dyadica.plans.engine import Engine
from dyadica.sources import io
from dyadica.streaming import exchange

PTS = "pt_id bigint, coords array<double>"


def config(**k):
    return io.CombiConfig(lmin=[2, 2], lmax=[4, 4], boundary=[2, 2], **k)


def test_engine_keeps_planes(spark):
    e = Engine(spark, config())
    e.run_first(lambda x: x[0] + 10 * x[1])
    for _ in range(2):
        e.run_next(lambda p, step: p.withColumn("value", F.col("value") + 1.0))
        e.combine()
    pts = spark.createDataFrame([(0, [0.3, 0.7]), (1, [0.5, 0.25])], PTS)
    got = {r["pt_id"]: r["value"] for r in e.interpolate(pts).collect()}
    assert abs(got[0] - 9.3) < 1e-12 and abs(got[1] - 5.0) < 1e-12
    assert all(abs(r["value"] - (2 + r["idx"][0] / 8 + 10 * r["idx"][1] / 8)) < 1e-12 for r in e.on_level([3, 3]).collect())
    assert e.norm(0).count() == 1 and e.min_max().count() > 0 and e.coefficient(999) == 0.0
    assert {r["event"] for r in e.timers().collect()} == {"run first", "run", "combine"}


def test_engine_regains_lost_grids(spark):
    e = Engine(spark, config(), scheme.classical(spark, [2, 2], [4, 4], fault_tolerant=True))
    e.run_first(lambda x: x[0] + 10 * x[1])
    whole = e.scheme
    lost = whole.where("level = array(3, 3)").select("task_id")
    e.points = e.points.join(lost, "task_id", "left_anti")
    e.scheme = spark.createDataFrame([r for r in whole.collect() if r["level"] != [3, 3]], whole.schema)
    fixed = faults.recovered([tuple(r["level"]) for r in whole.collect()], [(3, 3)])
    assert sum(fixed.values()) == 1
    e.scheme = e.scheme.select("task_id", "level").join(spark.createDataFrame([(list(l), float(c)) for l, c in fixed.items()], "level array<int>, coeff double"), "level", "left").na.fill(0.0, ["coeff"])
    e.update_scheme(whole)
    again = e.points.where("level = array(3, 3)")
    assert again.count() == 81 and all(abs(r["value"] - (r["idx"][0] + 10 * r["idx"][1]) / 8) < 1e-12 for r in again.collect())


def test_two_systems(spark, tmp_path):
    """Halves of a scheme, exchanged by files, give what the whole scheme gives."""
    s = scheme.classical(spark, [2, 2], [4, 4]).orderBy("level").collect()
    rows = [(i, r["level"], r["coeff"]) for i, r in enumerate(s)]
    f = lambda x: F.sin(3 * x[0]) * (1 + x[1])
    make = lambda part: Engine(spark, config(), spark.createDataFrame(part, "task_id bigint, level array<int>, coeff double"))
    whole, a, b = make(rows), make(rows[:2]), make(rows[2:])
    for e in (whole, a, b):
        e.top = [4, 4]
        e.run_first(f)
    b.write_sparse(str(tmp_path / "b"))
    a.combine_with_files([str(tmp_path / "b")])
    whole.combine()
    key = ["task_id", "idx"]
    j = a.points.select(*key, "value").join(whole.points.select(*key, F.col("value").alias("w")), key)
    assert j.count() == a.points.count() and j.agg(F.max(F.abs(F.col("value") - F.col("w")))).first()[0] < 1e-12


def test_dumps(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2], [1, 1], 3.0), (0, [2, 2], [2, 1], 4.0)], exchange.SPARSE)
    for k in "ab":
        io.write_sparse(df, str(tmp_path / k), parts=2)
    both = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert sorted(r["value"] for r in io.read_reduce(spark, both, [*combine.KEY, "sub_level"]).collect()) == [6.0, 8.0]
    assert io.exists(spark, both[0]) and io.delete(spark, both[0]) and not io.exists(spark, both[0])
    sizes = [spark.createDataFrame(x, "sub_level array<int>, n_points bigint") for x in ([([1, 1], 9), ([2, 1], 6)], [([1, 1], 9), ([1, 2], 6)], [([1, 1], 5)])]
    for k, s in enumerate(sizes):
        s.write.parquet(str(tmp_path / f"s{k}"))
    of = lambda how, n=3: {tuple(r["sub_level"]): r["n_points"] for r in io.reduce_sizes(spark, [str(tmp_path / f"s{k}") for k in range(n)], how).collect()}
    assert of("min") == {(1, 1): 5, (2, 1): 0, (1, 2): 0} and of("max") == {(1, 1): 9, (2, 1): 6, (1, 2): 6} and of("shared", 2) == {(1, 1): 9, (2, 1): 0, (1, 2): 0}


def test_texts(spark, tmp_path):
    ev = spark.createDataFrame([(0, 1, "solve", 5, 9), (1, 1, "wait", 20, 30)], io.TIMERS)
    io.write_timers(ev, str(tmp_path / "t"), since_us=10)
    assert [tuple(r) for r in io.read_timers(spark, str(tmp_path / "t")).collect()] == [(1, 1, "wait", 20, 30)]
    (tmp_path / "h.csv").write_text("2 3,100\n2 3,300\nbad\n4 4,7\n")
    h = {tuple(r["level"]): (r["load"], r["readings"]) for r in io.read_load_history(spark, str(tmp_path / "h.csv")).collect()}
    assert h == {(2, 3): (200.0, 2), (4, 4): (7.0, 1)}
    c = io.read_config("[ct]\ndim = 2\nlmin = 3 6\nlmax = 7 10\nncombi = 4\n[application]\ndt = 0.01\n[manager]\nngroup = 2\n")
    assert (c.lmin, c.lmax, c.boundary, c.ncombi, c.dt, c.groups) == ([3, 6], [7, 10], [2, 2], 4, 0.01, 2)
    with pytest.raises(ValueError):
        io.CombiConfig(lmin=[1], lmax=[2, 3], boundary=[2, 2])
    pts = spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.0, 0.0])], PTS)
    assert sorted(map(tuple, io.nested_coordinates(io.flat_coordinates(pts)).collect())) == [(1, [0.5, 0.25]), (2, [1.0, 0.0])]


def test_arriving_files(spark, tmp_path):
    src, seen = tmp_path / "in", []
    for k in range(2):
        spark.createDataFrame([(0, [1, 2], [1, 1], 3.0)], exchange.SPARSE).write.parquet(str(src / f"system{k}"))
    exchange.each_batch(spark, str(src), str(tmp_path / "cp"), lambda df, b: seen.extend(df.collect())).awaitTermination()
    assert sum(r["value"] for r in seen) == 6.0
    q = exchange.follow(spark, str(src), "arrived", str(tmp_path / "cp2"))
    q.processAllAvailable()
    assert spark.table("arrived").first()["value"] == 6.0
    q.stop()


def test_loads(spark):
    st = spark.createDataFrame([(1, s, d, t) for s, d, t in [(1, 10, 1.0), (2, 20, 2.0), (3, 60, 3.0), (3, 60, 3.0), (4, None, 4.0), (5, -1, 5.0), (6, 9, None)]], "task_id bigint, stat_id bigint, duration_us bigint, sim_time double")
    t = spark.createDataFrame([(1, [2, 2]), (2, [3, 4])], "task_id bigint, level array<int>")
    got = {r["task_id"]: (r["load"], r["readings"]) for r in sched.last_n(st, 2, t).collect()}
    assert got == {1: (40.0, 2), 2: (128.0, 0)}
    assert {r["task_id"]: r["load"] for r in sched.averages(st).collect()} == {1: 99 / 4}
    moves = sched.rebalance([(0, 0, 8.0), (1, 0, 2.0), (2, 0, 2.0), (3, 1, 1.0)], 10, 1.05)
    load = {0: 12.0, 1: 1.0}
    for task, a, b in moves:
        x = {0: 8.0, 1: 2.0, 2: 2.0, 3: 1.0}[task]
        load[a] -= x
        load[b] += x
    assert moves and max(load.values()) < 12.0 and sched.static_moves([]) == [] and sched.rebalance([(0, 0, 1.0)]) == []
    assert sched.moved(t.withColumn("group_no", F.lit(0)), [(2, 0, 5)]).where("group_no = 5").count() == 1


def test_recovered_coefficients():
    levels = [(2, 4), (3, 3), (4, 2), (2, 3), (3, 2)]
    assert faults.recovered(levels, []) == {(2, 4): 1, (3, 3): 1, (4, 2): 1, (2, 3): -1, (3, 2): -1}
    for lost in levels[:3]:
        c = faults.recovered(levels, [lost])
        assert lost not in c and sum(c.values()) == 1


def test_recovery_is_best():
    """Branch and bound against all weights."""
    import itertools

    levels, lost = [(1, 3), (2, 2), (3, 1), (1, 2), (2, 1)], [(2, 2), (1, 2)]
    nodes = faults.down_set(levels, (1, 1))
    best = -1.0
    for w in itertools.product((0, 1), repeat=len(nodes)):
        c = faults.coefficients_of(dict(zip(nodes, w)))
        if not set(lost) & set(c):
            best = max(best, sum(4.0 ** -sum(l) * x for l, x in zip(nodes, w)))
    got = faults.recovered(levels, lost)
    weight = lambda l: sum(x for m, x in got.items() if all(a >= b for a, b in zip(m, l)))
    assert abs(sum(4.0 ** -sum(l) * weight(l) for l in nodes) - best) < 1e-12


def test_statistics(spark):
    ev = spark.createDataFrame([(0, "a", 0, 10, "x"), (0, "a", 0, 10, "y"), (0, "a", 20, 50, "x"), (1, "a", 0, 20, "x"), (1, None, 0, 1, "x"), (2, "b", 5, 5, "x")], "rank int, event string, t_start_us bigint, t_end_us bigint, flushed_at string")
    d = stats.durations(ev)
    r = stats.timer_statistics(d, ["event"]).first()
    assert (r["n"], r["least"], r["largest"], r["mean"], r["median"], r["total"]) == (3, 10, 30, 20.0, 20.0, 60)
    i = stats.imbalance(d).first()
    assert (i["imbalance"], i["slowest"], i["ranks"]) == (1.0, 0, 2)
    assert stats.numbered_steps(d).agg(F.max("step")).first()[0] == 1
    t = stats.transfer_statistics(spark.createDataFrame([("x", 10, 2.0), ("x", 20, 1.0)], "kind string, bytes bigint, seconds double")).first()
    assert (t["n"], t["rate"]) == (2, 10.0)


def test_sampling(spark):
    p = interp.random_points(spark, 4000, 2, seed=1)
    q = interp.random_points(spark, 4000, 2, seed=1).repartition(7)
    assert p.exceptAll(q).count() == 0
    m = p.agg(*[F.avg(F.col("coords")[d]).alias(f"m{d}") for d in (0, 1)], F.max(F.col("coords")[0]).alias("x")).first()
    assert abs(m["m0"] - 0.5) < 0.03 and abs(m["m1"] - 0.5) < 0.03 and m["x"] < 1
    v = p.select("pt_id", F.lit(2.0).alias("value"))
    assert interp.moments(v, p, 2).first()["mass"] == 2.0
    e = interp.mc_errors(v, v).first()
    assert e["linf"] == 0 and e["rel_l1"] == 0
    w = faults.weibull_times(spark.range(2000).select(F.col("id").alias("rank")), 1.0, 10.0)
    assert abs(w.agg(F.avg("fault_at")).first()[0] - 10) < 1


@pytest.mark.parametrize("floor", [1 << 20, 40])
def test_medians(spark, floor):
    import random
    import statistics

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2, 2, None]) if rng.random() < 0.3 else rng.randrange(500)) for _ in range(700)] + [("c", 7), ("d", None)]
    got = {r["k"]: r["median"] for r in stats.medians(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v", floor).collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in want.items()}


def test_recovery_ends_and_is_exact_in_more_dimensions():
    import itertools

    from dyadica.operators import faults

    def active(dim, n):
        return [tuple(1 + x for x in e) for s in range(max(0, n - dim + 1), n + 1) for e in itertools.product(range(n + 1), repeat=dim) if sum(e) == s]

    for dim, n in ((4, 5), (6, 4)):
        levels = active(dim, n)
        lost = faults.random_faults(levels, 5, seed=dim)
        c = faults.recovered(levels, lost)
        assert not set(c) & set(lost) and sum(c.values()) == 1
    middle = (2, 2, 1)
    levels, lost = active(3, 2), [middle, (3, 1, 1), (1, 1, 1)]
    nodes = faults.down_set(levels, (1, 1, 1))
    best = max(sum(4.0 ** -sum(l) * x for l, x in zip(nodes, w)) for w in itertools.product((0, 1), repeat=len(nodes)) if not any(faults.coefficients_of(dict(zip(nodes, w))).get(f) for f in lost))
    c = faults.recovered(levels, lost)
    weight = lambda l: sum(x for m, x in c.items() if all(a >= b for a, b in zip(m, l)))
    assert sum(4.0 ** -sum(l) * weight(l) for l in nodes) == best
    # a dummy dimension changes nothing
    flat = faults.recovered([(*l, 4) for l in levels], [(*l, 4) for l in lost])
    assert flat == {(*l, 4): x for l, x in c.items()} and faults.varying([(*l, 4) for l in levels]) == [0, 1, 2]


def test_a_task_moves_once(spark):
    import random

    from dyadica.operators import sched

    for seed in range(300):
        rng = random.Random(seed)
        tasks = [(t, rng.randrange(4), float(rng.randrange(1, 50))) for t in range(12)]
        for before in (False, True):
            moves = sched.rebalance(tasks, 20, 1.01, as_before=before)
            assert len({m[0] for m in moves}) == len(moves) and all(a == dict((t, g) for t, g, _ in tasks)[m] for m, a, _ in moves)
    s = spark.createDataFrame([(1, 0), (2, 0)], "task_id bigint, group_no int")
    assert sorted(map(tuple, sched.moved(s, [(1, 0, 3), (1, 3, 5)]).collect())) == [(1, 5), (2, 0)]


def test_chunks_combine_as_one(spark):
    """A chunk of subspaces at a time gives what all at once gives; durations are shared out by points."""
    f = lambda x: grids.cosine_product(x) + x[0] * x[1] * 3
    values = []
    for chunked in (False, True):
        e = Engine(spark, io.CombiConfig(lmin=[2, 1], lmax=[4, 3], boundary=[2, 2], chunk_points=30))
        assert e.low == [2, 1]
        e.run_first(f)
        e.run_next(lambda p, step: p)
        assert (e.combine_chunks() > 3) if chunked else e.combine() is None
        values.append({(r["task_id"], tuple(r["idx"])): round(r["value"], 10) for r in e.points.collect()})
        st = e.task_stats().collect()
        assert len(st) == e.scheme.count() and all(r["duration_us"] > 0 and r["sim_time"] > 0 for r in st)
    assert values[0] == values[1] and len(values[0]) > 100


def test_standard_cuts():
    assert grids.standard_cuts([3, 4, 5], [1, 2, 4]) == [[0], [0, 9], [0, 9, 17, 25]]


def test_extra_sparse_grid(spark):
    from dyadica.operators import combine

    sg = spark.createDataFrame([(0, [0], [1], 1.0), (0, [2], [2], 2.0), (0, [3], [3], 3.0)], "field_id int, x_key array<bigint>, sub_level array<int>, value double")
    extra = combine.conjoint(sg, spark.createDataFrame([([1],), ([2],), ([1],)], "level array<int>"))
    assert sorted(r["value"] for r in extra.collect()) == [1.0, 2.0]
    back = combine.updated(sg, extra.withColumn("value", F.col("value") * 10))
    assert sorted(r["value"] for r in back.collect()) == [3.0, 10.0, 20.0]
    sizes = spark.createDataFrame([([1], 3), ([2], 4)], "sub_level array<int>, n_points bigint")
    assert combine.total_points(sizes).first()[0] == 7 and combine.total_points(sizes, sg.where("value = 3")).first()[0] == 0
