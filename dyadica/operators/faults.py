"""Faults: which tasks are lost, and the coefficients that do without them."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Level = tuple[int, ...]


def static_faults(steps: DataFrame, faults: DataFrame) -> DataFrame:
    """The (step, rank) rows at which a fault is planned."""
    return steps.join(faults.select("step", "rank").distinct(), ["step", "rank"], "left_semi")


def weibull_times(ranks: DataFrame, shape: float, scale: float, seed: int = 0) -> DataFrame:
    """``fault_at`` for each rank: scale * (-ln(1 - u))^(1/shape), u a hash of the rank, the same in every run."""
    u = F.xxhash64("rank", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return ranks.withColumn("fault_at", scale * F.pow(-F.log(1 - u), F.lit(1.0 / shape)))


def failed_tasks(scheme: DataFrame, groups: DataFrame) -> DataFrame:
    """The tasks of failed groups."""
    return scheme.join(groups.select("group_no").distinct(), "group_no", "left_semi")


def surviving_tasks(scheme: DataFrame, groups: DataFrame) -> DataFrame:
    return scheme.join(groups.select("group_no").distinct(), "group_no", "left_anti")


def split_faults(scheme: DataFrame, faulty: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The faulty grids with ``recompute``: those below the top two diagonals of the scheme, or of their own of several told apart by ``by``, are computed again, the others left to new coefficients."""
    from dyadica.functions import levels as L

    own = F.lit(0) if not by else F.struct(*by)
    top = scheme.groupBy(own.alias("_own")).agg(F.max(L.total(F.col("level"))).alias("_top"))
    hit = scheme.join(faulty.select(*(by or []), "task_id").distinct(), [*(by or []), "task_id"], "left_semi").withColumn("_own", own)
    return hit.join(top, "_own").withColumn("recompute", L.total(F.col("level")) < F.col("_top") - 1).drop("_own", "_top")


# The recovery of coefficients looks at the levels of one scheme: a small set, on the driver.


def down_set(levels: Iterable[Level], least: Level) -> list[Level]:
    out: set[Level] = set()
    for l in levels:
        out |= set(itertools.product(*[range(a, b + 1) for a, b in zip(least, l)]))
    return sorted(out)


def coefficients_of(weights: dict[Level, int], dims: list[int] | None = None) -> dict[Level, int]:
    """c = M^-1 w: each level takes (-1)^|e| of the weight e above it, e in the dimensions ``dims`` or in all."""
    dim = len(next(iter(weights)))
    steps = list(itertools.product(*[(0, 1) if dims is None or d in dims else (0,) for d in range(dim)]))
    c = {l: sum((-1) ** sum(e) * weights.get(tuple(a + b for a, b in zip(l, e)), 0) for e in steps) for l in weights}
    return {l: x for l, x in c.items() if x}


def _most(gains: list[int], counts: list[int], signs: list[tuple[int, ...]]) -> list[int]:
    """The counts x, 0 <= x <= counts, with the largest sum of gains * x among those with sum of signs * x = 0 in every place.

    Branch and bound to the end, so the result is proven. The classes come by falling gain. A branch is left if some sum can't be brought to 0
    any more, or if even the cheapest way to bring the worst one to 0 costs too much.
    """
    places, n = range(len(signs[0]) if signs else 0), len(gains)
    rest = [sum(g * c for g, c in zip(gains[i:], counts[i:])) for i in range(n + 1)]
    best, best_x = -1, [0] * n

    def least_loss(i: int, total: list[int]) -> int | None:
        """What any way to make the sums 0 costs at least, from all that is left being taken; None if there is no way."""
        worst = 0
        for p in places:
            over = total[p] + sum(signs[j][p] * counts[j] for j in range(i, n))
            loss, sign = 0, 1 if over > 0 else -1
            for j in range(n - 1, i - 1, -1):  # the cheapest first
                if not over:
                    break
                if signs[j][p] == sign:
                    k = min(counts[j], abs(over))
                    over, loss = over - sign * k, loss + k * gains[j]
            if over:
                return None
            worst = max(worst, loss)
        return worst

    stack: list[tuple[int, int, list[int], list[int]]] = [(0, 0, [0 for _ in places], [])]
    while stack:
        i, q, total, x = stack.pop()
        loss = least_loss(i, total)
        if loss is None or q + rest[i] - loss <= best:
            continue
        if i == n:
            best, best_x = q, x
            continue
        for k in range(counts[i] + 1):  # the most is looked at first
            stack.append((i + 1, q + k * gains[i], [t + k * s for t, s in zip(total, signs[i])], [*x, k]))
    return best_x


def recovered(levels: Iterable[Level], faulty: Iterable[Level]) -> dict[Level, int]:
    """New coefficients: the most of sum 4^-|l| w_l with w in {0, 1}, so that no faulty grid has a coefficient.

    A set of weights need not be closed downward. Without a fault the weights are all 1, as are those that no faulty grid's coefficient depends on.
    Weights of equal gain that the same coefficients depend on alike are interchangeable, so only how many of them are 1 is searched for; the lowest of them are.
    The result is the proven best. Dimensions in which all levels are the same are left aside.
    """
    levels, faulty = list(levels), set(faulty)
    least = tuple(min(l[d] for l in levels) for d in range(len(levels[0])))
    free = [d for d in range(len(least)) if any(l[d] != least[d] for l in levels)]
    nodes = down_set(levels, least)
    lost = sorted(faulty & set(nodes))
    finest = max(map(sum, nodes))

    def sign(node: Level, fault: Level) -> int:
        e = [a - b for a, b in zip(node, fault)]
        return (-1) ** sum(e) if all(x in (0, 1) for x in e) else 0

    classes: dict[tuple[int, tuple[int, ...]], list[Level]] = {}
    w = dict.fromkeys(nodes, 1)
    for l in nodes:
        of = tuple(sign(l, f) for f in lost)
        if any(of):
            classes.setdefault((sum(l), of), []).append(l)
    keys = sorted(classes)
    x = _most([4 ** (finest - k[0]) for k in keys], [len(classes[k]) for k in keys], [k[1] for k in keys])
    for k, n in zip(keys, x):
        for l in sorted(classes[k])[n:]:
            w[l] = 0
    return coefficients_of(w, free)


# Helpers over sets of faults.


def varying(levels: Iterable[Level]) -> list[int]:
    """The dimensions in which the levels differ; the others are dummies."""
    levels = list(levels)
    return [d for d in range(len(levels[0])) if len({l[d] for l in levels}) > 1]


def without_dummies(levels: Iterable[Level], dims: list[int]) -> list[Level]:
    """Levels of the dimensions ``dims`` alone."""
    return [tuple(l[d] for d in dims) for l in levels]


def random_faults(levels: Iterable[Level], count: int, seed: int = 0) -> list[Level]:
    """``count`` of the levels, the same for the same seed whatever their order."""
    import random

    ordered = sorted(set(levels))
    return sorted(random.Random(seed).sample(ordered, min(count, len(ordered))))
