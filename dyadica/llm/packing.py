"""Filling fixed-capacity containers with texts, sized in tokens of a public tokenizer.

How many items there are of each size is all that a packing needs to know, and there are no more
sizes than the capacity has tokens. So the packing is planned on that histogram, in the driver, in
memory and time that do not grow with the data: a plan is a list of runs, "of the items of size s,
numbers a to b fill the containers from c on, j to each". Items above a third of the capacity come first: at most
two fit a container, and each is matched greedily with the largest that fits beside it. The smaller sizes, in
falling order, go to the smallest gap that takes them. Items then get their numbers among
those of equal size by counts of blocks of rows, without sorting all items of a size in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadica.llm import vocab
from dyadica.session import stored

#: Largest capacity that a plan is made for, and most targets at once: the bounds of the driver's memory.
MAX_CAPACITY, MAX_TARGETS = 1 << 17, 64
#: Rows in a block that gets its numbers in one task.
BLOCK = 50_000


@dataclass(frozen=True)
class Run:
    """Items ``first`` to ``first + items - 1`` of ``size`` fill containers from ``bin`` on, ``each`` to one."""

    size: int
    first: int
    items: int
    bin: int
    each: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs for all items of ``histogram`` (size to count), and the number of containers."""
    runs: list[Run] = []
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 0 or s > capacity for s in left):
        raise ValueError("an item does not fit a container")
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first container, number of containers)
    order: list[int] = []
    bins = 0

    def put(size: int, items: int, at: int, each: int = 1) -> None:
        runs.append(Run(size, used[size], items, at, each))
        used[size] += items
        left[size] -= items

    def room(gap: int, at: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((at, n))

    def take(gap: int) -> tuple[int, int]:
        at = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            order.remove(gap)
        return at

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    rising = large[::-1]
    for s in large:
        while left[s]:
            i = bisect_left(rising, capacity - s + 1) - 1
            if i >= 0 and rising[i] == s and left[s] < 2:
                i -= 1
            t = rising[i] if i >= 0 else None
            n = left[s] if t is None else left[s] // 2 if t == s else min(left[s], left[t])
            at, bins = bins, bins + n
            put(s, n, at)
            if t is not None:
                put(t, n, at)
            for x in {s, t or s}:
                if not left[x]:
                    del rising[bisect_left(rising, x)]
            room(capacity - s - (t or 0), at, n)
    for s in sorted((s for s in left if 0 < 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(order, s)
            gap = order[i] if i < len(order) else capacity
            j = gap // s
            if i < len(order):
                at, n = take(gap)
            else:
                n = -(-left[s] // j)
                at, bins = bins, bins + n
            full = min(n, left[s] // j)
            rest = left[s] - full * j if full < n else 0
            if full:
                put(s, full * j, at, j)
                room(gap - j * s, at, full)
            if rest:
                put(s, rest, at + full, rest)
                room(gap - rest * s, at + full, 1)
            room(gap, at + full + bool(rest), n - full - bool(rest))
    if left.get(0):
        bins = max(bins, 1)
        put(0, left[0], 0, left[0])
    return runs, bins


def token_counts(docs: DataFrame, tokenizers: list[str], folder: str = vocab.FOLDER) -> DataFrame:
    """doc_id and ``n0``, ``n1``...: each non-empty text's tokens by each of ``tokenizers``; the text goes to Python once."""
    schema = "doc_id bigint, " + ", ".join(f"n{i} bigint" for i in range(len(tokenizers)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = [vocab.counter(t, folder) for t in tokenizers]
        for b in batches:
            texts = b["text"].tolist()
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), **{f"n{i}": np.asarray(f(texts), np.int64) for i, f in enumerate(of)}})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL AND text != ''").mapInPandas(count, schema)


def targets_of(table: DataFrame, folder: str = vocab.FOLDER) -> list[Row]:
    """The usable targets: those without an id or a capacity above zero, or with a tokenizer that there
    isn't, are left out, and so get no containers; of a repeated id the largest capacity counts, and of equal ones the first tokenizer by name."""
    rows = table.select("pack_id", "tokenizer", "capacity_tokens").where("pack_id IS NOT NULL AND capacity_tokens > 0 AND tokenizer IS NOT NULL").distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS or any(r["capacity_tokens"] > MAX_CAPACITY for r in rows):
        raise ValueError(f"at most {MAX_TARGETS} targets of at most {MAX_CAPACITY} tokens")
    usable = [r for r in rows if vocab.counter(r["tokenizer"], folder)]
    one: dict[int, Row] = {}
    for r in sorted(usable, key=lambda r: (r["pack_id"], -r["capacity_tokens"], r["tokenizer"])):
        one.setdefault(r["pack_id"], r)
    return list(one.values())


SCHEMA = "pack_id int, doc_id bigint, part_no int, n_tokens bigint, bin_id bigint"


def pack(docs: DataFrame, targets: DataFrame, folder: str = vocab.FOLDER) -> DataFrame:
    """One row per target and item: ``pack_id, doc_id, part_no, n_tokens, bin_id`` (from 0).

    An item is a non-empty text, or, of a text that alone exceeds the capacity, each of its parts:
    full ones and a rest. A text of no tokens goes to container 0. Null and empty texts have no item;
    a document delivered twice has two. Equal sizes are told apart by ``doc_id`` and ``part_no``. No target or
    no text gives an empty table.
    """
    spark = docs.sparkSession
    wanted = targets_of(targets, folder)
    if not wanted:
        return spark.createDataFrame([], SCHEMA)
    names = sorted({r["tokenizer"] for r in wanted})
    sizes = stored(token_counts(docs, names, folder))
    of = F.array(*[F.struct(F.lit(r["pack_id"]).cast("int").alias("pack_id"), F.lit(r["capacity_tokens"]).cast("bigint").alias("cap"), F.col(f"n{names.index(r['tokenizer'])}").alias("n")) for r in wanted])
    blocks = max(1, -(-sizes.count() // BLOCK))
    items = sizes.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("blk"), F.inline(of))
    items = items.select("pack_id", "doc_id", "blk", "n", "cap", F.explode(F.expr("sequence(0, CAST(greatest(n - 1, 0) div cap AS INT))")).alias("part_no"))
    items = items.select("pack_id", "doc_id", "blk", "part_no", F.expr("least(cap, n - part_no * cap)").alias("n_tokens"))
    counts = items.groupBy("pack_id", "n_tokens", "blk").agg(F.count(F.lit(1)).alias("n"))
    hist = counts.groupBy("pack_id", "n_tokens").agg(F.sum("n").alias("n")).collect()  # at most capacity + 1 rows a target
    table: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for r in wanted:
        runs, _ = plan({h["n_tokens"]: h["n"] for h in hist if h["pack_id"] == r["pack_id"]}, r["capacity_tokens"])
        by: dict[int, list[Run]] = {}
        for x in runs:
            by.setdefault(x.size, []).append(x)
        for s, xs in by.items():
            xs.sort(key=lambda x: x.first)
            table[r["pack_id"], s] = tuple(np.array([getattr(x, k) for x in xs], np.int64) for k in ("first", "bin", "each"))
    shared = spark.sparkContext.broadcast(table)
    w = Window.partitionBy("pack_id", "n_tokens").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("pack_id", "n_tokens", "blk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("pack_id", "n_tokens", "blk").orderBy("doc_id", "part_no"))
    numbered = items.withColumn("own", own).join(before, ["pack_id", "n_tokens", "blk"]).select("pack_id", "doc_id", "part_no", "n_tokens", (F.col("before") + F.col("own") - 1).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            out = np.empty(len(b), np.int64)
            for key, at in b.groupby(["pack_id", "n_tokens"], sort=False).indices.items():
                first, start, each = known[key]
                rank = b["rank"].to_numpy()[at]
                i = np.searchsorted(first, rank, "right") - 1
                out[at] = start[i] + (rank - first[i]) // each[i]
            yield b.assign(bin_id=out)[["pack_id", "doc_id", "part_no", "n_tokens", "bin_id"]]

    return numbered.mapInPandas(place, SCHEMA)


def fill(packed: DataFrame, targets: DataFrame, folder: str = vocab.FOLDER) -> DataFrame:
    """Per target: containers, items, tokens, the least number of containers that could hold them, and the share filled."""
    caps = packed.sparkSession.createDataFrame([(r["pack_id"], r["capacity_tokens"]) for r in targets_of(targets, folder)], "pack_id int, capacity_tokens bigint")
    per = packed.groupBy("pack_id", "bin_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    per = per.groupBy("pack_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return per.join(caps, "pack_id").select("pack_id", "capacity_tokens", "bins", "items", "tokens", "fullest", F.expr("(tokens + capacity_tokens - 1) div capacity_tokens").alias("least_bins"), F.expr("CAST(tokens AS DOUBLE) / (bins * capacity_tokens)").alias("filled"))
