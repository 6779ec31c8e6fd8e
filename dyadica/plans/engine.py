"""A run of the combination technique: solve, combine, evaluate, step by step.

The driver owns the loop over steps; everything in a step is declared on DataFrames. The state is the
component grids; after each step it is written to a reliable checkpoint, so that the plan doesn't grow and a lost
executor costs one step at most.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadica.functions import levels as L
from dyadica.operators import combine, grids, interp, norms, scheme, transform
from dyadica.operators.skew import numbered
from dyadica.session import cut, stored
from dyadica.sources import io
from dyadica.sources.io import CombiConfig

Solver = Callable[[DataFrame, int], DataFrame]


class Engine:
    """One system's grids and what is asked of them.

    ``solver(points, step)`` takes the points with levels and returns them changed.
    """

    def __init__(self, spark: SparkSession, config: CombiConfig, scheme_df: DataFrame | None = None) -> None:
        self.spark, self.config = spark, config
        self.step = 0
        base = scheme_df if scheme_df is not None else scheme.from_json(spark, config.scheme) if config.scheme else scheme.classical(spark, config.lmin, config.lmax)
        if "task_id" not in base.columns:
            base = numbered(base, ["level"], "task_id")
        self.scheme = cut(base)
        self.bases = config.bases or [transform.default_basis(b) for b in config.boundary]
        self.events: list[tuple[int, int, str, int, int]] = []
        self.began = time.time()
        self.top = [max(r) for r in zip(*[r["level"] for r in self.scheme.select("level").distinct().collect()])]
        # transforms stop at the lowest level that all grids have; see transform for grids without boundary
        self.low = [min(a, *(r["level"][d] for r in self.scheme.select("level").distinct().collect())) for d, a in enumerate(config.lmin)]
        self.points: DataFrame | None = None
        self.runs: list[tuple[int, int]] = []

    @contextmanager
    def timed(self, event: str) -> Iterator[None]:
        """Append an interval to the timer events of the driver."""
        a = int((time.time() - self.began) * 1e6)
        yield
        self.events.append((0, 0, event, a, int((time.time() - self.began) * 1e6)))

    def timers(self) -> DataFrame:
        return self.spark.createDataFrame(self.events, io.TIMERS)

    # -- tasks

    def run_first(self, function: Callable[[list[Column]], Column], fields: int = 1) -> None:
        """Create the grids with values of ``function`` at the coordinates."""
        if len(set(self.config.boundary)) != 1:
            raise ValueError("grids are made with one kind of boundary")
        with self.timed("run first"):
            each = self.scheme.select("task_id", "level", F.explode(F.array(*[F.lit(f) for f in range(fields)])).alias("field_id"))
            self.points = cut(grids.filled(each, self.config.dim, function, self.config.boundary[0]).select(*grids.POINT, "value", "level"))

    def run_next(self, solver: Solver) -> None:
        """A step of the solver on every grid."""
        began = time.time()
        with self.timed("run"):
            self.points = cut(solver(self.points, self.step))
        self.runs.append((self.step, int((time.time() - began) * 1e6)))
        self.step += 1

    def task_stats(self) -> DataFrame:
        """task_id, level, stat_id, sim_time, duration_us for the load models: what each step took, shared out by grid points, as all grids run in one job."""
        sized = scheme.combi_dof(self.scheme.select("task_id", "level"), self.config.boundary[0])
        total = sized.agg(F.sum("dof")).first()[0]
        steps = F.from_json(F.lit(json.dumps([{"step": s, "took": t} for s, t in self.runs])), "array<struct<step:int,took:bigint>>")
        each = sized.select("task_id", "level", "dof", F.inline(steps)).withColumn("_all", F.lit(total))
        at = F.round(F.col("took") * F.col("dof") / F.col("_all")).cast("bigint")
        return each.select("task_id", "level", F.xxhash64("task_id", "step").alias("stat_id"), ((F.col("step") + 1) * self.config.nsteps * self.config.dt).alias("sim_time"), at.alias("duration_us"))

    def update_scheme(self, scheme_df: DataFrame) -> None:
        """New coefficients or groups; grids that left the scheme are dropped, new ones filled from the sparse grid."""
        with self.timed("update scheme"):
            new = scheme_df.join(self.scheme.select("task_id"), "task_id", "left_anti").select("task_id", "level")
            kept = self.points.join(scheme_df.select("task_id"), "task_id", "left_semi")
            if not new.isEmpty():
                target = new.withColumn("top", L.vec(self.top))
                fresh = combine.onto(self.sparse(), target, self.config.dim)
                kept = kept.unionByName(self._nodal(fresh.select(*kept.columns)))
            self.points = cut(kept)
            self.scheme = cut(scheme_df)

    def coefficient(self, task_id: int) -> float:
        """The coefficient of a task, 0 if it is unknown."""
        r = self.scheme.where(F.col("task_id") == task_id).select("coeff").first()
        return r["coeff"] if r else 0.0

    # -- combination

    def _hierarchical(self) -> DataFrame:
        return transform.hierarchize(self.points, self.config.dim, self.bases, boundary=self.config.boundary, lmin=self.low)

    def _nodal(self, points: DataFrame) -> DataFrame:
        return transform.dehierarchize(points, self.config.dim, self.bases, boundary=self.config.boundary, lmin=self.low)

    def _keyed(self) -> DataFrame:
        return combine.keyed(self._hierarchical().join(self.scheme.select("task_id", "coeff"), "task_id").withColumn("top", L.vec(self.top)))

    def _gathered(self, keyed: DataFrame) -> DataFrame:
        if self.config.reduce_lmax:
            keyed = combine.below(keyed, combine.reduced_top(self.config.lmin, self.top, self.config.reduce_lmax))
        return combine.gather(keyed)

    def sparse(self) -> DataFrame:
        """The combined hierarchical values: what is exchanged with other systems."""
        return self._gathered(self._keyed())

    def combine_chunks(self) -> int:
        """Combine as :meth:`combine` does, a chunk of subspaces of at most ``chunk_points`` points at a time; how many chunks there were.

        The whole sparse grid is never there at once; each chunk's part of the grids is written before the next."""
        with self.timed("combine"):
            keyed = stored(self._keyed())
            sizes = combine.subspaces(keyed).select("sub_level", "n_points").orderBy("sub_level").collect()  # a row for each subspace
            chunks = combine.chunks([(r["sub_level"], r["n_points"]) for r in sizes], self.config.chunk_points)
            back: DataFrame | None = None
            for levels in chunks:
                named = self.spark.createDataFrame([(x,) for x in levels], "sub_level array<int>")
                part = keyed.join(named, "sub_level", "left_semi")
                one = stored(combine.scatter(part, self._gathered(part)).select(*grids.POINT, "value", "level"))
                back = one if back is None else back.unionByName(one)
            if back is not None:
                self.points = cut(self._nodal(back))
        return len(chunks)

    def combine(self, *others: DataFrame) -> None:
        """Combine all grids, with the sparse grids of other systems if there are any, and write the result back to them."""
        if 0 in self.config.boundary:
            raise ValueError("keys are defined for grids with boundary points")
        with self.timed("combine"):
            keyed = stored(self._keyed())
            sg = self._gathered(keyed)
            if others:
                sg = combine.summed(sg, *others)
            back = combine.scatter(keyed, sg)
            self.points = cut(self._nodal(back.select(*grids.POINT, "value", "level")))

    # -- evaluation

    def interpolate(self, points: DataFrame) -> DataFrame:
        """pt_id, field_id, value: every grid evaluated at the points, then combined."""
        b = self.config.boundary[0]
        return interp.combined(self.interpolate_tasks(points, b), self.scheme)

    def interpolate_tasks(self, points: DataFrame, boundary: int | None = None) -> DataFrame:
        b = self.config.boundary[0] if boundary is None else boundary
        return interp.at_points(self.points, grids.tasks_of(self.scheme), points, self.config.dim, b)

    def on_level(self, level: list[int]) -> DataFrame:
        """The combined solution on a full grid of any level up to the scheme's finest."""
        target = self.spark.createDataFrame([(0, level, self.top)], "task_id bigint, level array<int>, top array<int>")
        full = combine.onto(self.sparse(), target, self.config.dim)
        return self._nodal(full.select(*grids.POINT, "value", "level"))

    def norm(self, p: int) -> DataFrame:
        w = norms.weighted(self.points, p)
        return w.join(self.scheme.select("task_id", "coeff"), "task_id").groupBy("field_id").agg(F.sum(F.col("coeff") * F.col("norm")).alias("norm"))

    def min_max(self) -> DataFrame:
        return combine.min_max(self.sparse())

    # -- exchange

    def write_sparse(self, path: str) -> None:
        with self.timed("write sparse"):
            io.write_sparse(self.sparse(), path)

    def combine_with_files(self, paths: list[str]) -> None:
        """Combine with the sparse grids that other systems have written."""
        self.combine(io.read_reduce(self.spark, paths, [*combine.KEY, "sub_level"]))
