from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dyadica.llm import packing, vocab
from dyadica.llm.packing import fill, pack, plan, targets_of


def unpacked(runs):
    bins, seen = {}, {}
    for r in runs:
        for k in range(r.items):
            bins.setdefault(r.bin + k // r.each, []).append(r.size)
            seen.setdefault(r.size, []).append(r.first + k)
    return bins, seen


@given(st.dictionaries(st.integers(0, 30), st.integers(0, 40), max_size=25), st.integers(30, 64))
@settings(max_examples=300, deadline=None)
def test_plan_is_whole_and_fits(histogram, capacity):
    runs, n = plan(histogram, capacity)
    bins, seen = unpacked(runs)
    assert {s: sorted(x) for s, x in seen.items()} == {s: list(range(c)) for s, c in histogram.items() if c}
    assert all(sum(b) <= capacity for b in bins.values())
    assert set(bins) == set(range(n))
    assert all(sum(3 * x > capacity for x in b) <= 2 for b in bins.values())
    total = sum(s * c for s, c in histogram.items())
    assert n <= max(1.6 * -(-total // capacity) + 1, sum(c for s, c in histogram.items() if 2 * s > capacity) + 1.3 * -(-total // capacity) + 1)


def test_plan_is_tight_and_grows_with_sizes_not_items():
    rng = random.Random(1)
    hist = {s: rng.randrange(1, 400_000) for s in range(1, 2049)}
    runs, n = plan(hist, 2048)
    least = -(-sum(s * c for s, c in hist.items()) // 2048)
    assert n <= 1.02 * least and len(runs) < 200_000


def test_plan_is_no_worse_than_best_fit_decreasing():
    rng = random.Random(2)
    for cap in (50, 100):
        items = [rng.choice([rng.randrange(1, cap // 3), rng.randrange(1, cap + 1)]) for _ in range(400)]
        bins = []
        for s in sorted(items, reverse=True):
            fit = [b for b in bins if sum(b) + s <= cap]
            if fit:
                max(fit, key=sum).append(s)
            else:
                bins.append([s])
        hist = {s: items.count(s) for s in set(items)}
        assert plan(hist, cap)[1] <= len(bins) * 1.02 + 1


def test_plan_refuses():
    with pytest.raises(ValueError):
        plan({11: 1}, 10)
    assert plan({}, 10) == ([], 0)
    assert plan({0: 4}, 10)[1] == 1


@pytest.mark.skipif(not os.path.exists(vocab.FOLDER), reason="no vocabulary files here")
def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 7)
    texts = [None, "", " ", "word", "word", "a longer text of several words", "x y " * 300, "long " * 64, "long " * 63] + [f"text number {i} " * (i % 9 + 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "n", 5) for i, t in enumerate(texts)] + [(None, "no id", "n", 5)], "doc_id bigint, text string, n string, bin_id int")
    targets = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "piece_bpe_32k", 32), (2, "piece_bpe_32k", 32), (3, "none_such", 10), (4, "byte_bpe_50k", 0), (None, "byte_bpe_50k", 5), (5, None, 5)], "pack_id int, tokenizer string, capacity_tokens int")
    rows = pack(docs, targets).collect()
    for pack_id, name, cap in ((1, "byte_bpe_50k", 64), (2, "piece_bpe_32k", 32)):
        mine = [r for r in rows if r["pack_id"] == pack_id]
        size = dict(zip([*range(len(texts)), None], vocab.counter(name)([t or "" for t in texts] + ["no id"])))
        per, bins = {}, {}
        for r in mine:
            per.setdefault(r["doc_id"], []).append((r["part_no"], r["n_tokens"]))
            bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
        assert set(per) == {i for i, t in enumerate(texts) if t} | {None}
        for d, p in per.items():
            p.sort()
            assert [k for k, _ in p] == list(range(len(p))) and sum(n for _, n in p) == size[d]
            assert len(p) == max(1, -(-size[d] // cap)) and all(n == cap for _, n in p[:-1])
        assert max(bins.values()) <= cap and set(bins) == set(range(len(bins)))
    f = {r["pack_id"]: r for r in fill(pack(docs, targets), targets).collect()}
    assert set(f) == {1, 2} and all(r["fullest"] <= r["capacity_tokens"] and r["bins"] >= r["least_bins"] for r in f.values())
    assert pack(docs.where("false"), targets).count() == 0 and pack(docs, targets.where("false")).count() == 0


def test_repeated_targets(spark):
    """The largest capacity of a usable tokenizer, whatever the order of the rows."""
    rows = [(1, "byte_bpe_50k", 8), (1, "none", 99), (1, "byte_bpe_multi_50k", 16), (1, "byte_bpe_50k", 16), (1, "byte_bpe_50k", 8), (None, "byte_bpe_50k", 4), (2, None, 4), (3, "byte_bpe_50k", 0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "pack_id int, tokenizer string, capacity_tokens int")
        assert [tuple(r) for r in targets_of(df)] == [(1, "byte_bpe_50k", 16)]


def test_plan_of_many_sizes_is_quick():
    import time

    began = time.time()
    runs, bins = plan({s: 1 + s % 3 for s in range(1, 65537)}, 65536)
    assert time.time() - began < 20 and bins >= -(-sum(s * (1 + s % 3) for s in range(1, 65537)) // 65536)
