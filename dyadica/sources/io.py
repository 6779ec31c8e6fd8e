"""Sources and sinks: schemes, grids and sparse grids, timers, coordinates and load histories.

Dumps are Parquet, compressed with lz4: columns can be read alone and parts are files of a folder, so a
dump written in one or in many parts is read the same way.
"""

from __future__ import annotations

import configparser
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadica.session import delete_on_exit, shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a dump that was read; whether there was one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_sparse(df: DataFrame, path: str, parts: int | None = None, mode: str = "errorifexists") -> None:
    """Write a sparse grid, or any other table, compressed; ``parts`` files if given."""
    (df.repartition(parts) if parts else df).write.mode(mode).option("compression", "lz4").parquet(path)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_reduce(spark: SparkSession, paths: list[str], key: list[str], how: str = "sum") -> DataFrame:
    """Several dumps read and reduced by key: ``sum``, ``min`` or ``max`` of ``value``."""
    return spark.read.parquet(*paths).groupBy(*key).agg(getattr(F, how)("value").alias("value"))


def reduce_sizes(spark: SparkSession, paths: list[str], how: str) -> DataFrame:
    """Subspace sizes of several systems: ``min``, ``max``, or ``shared`` (the size where more than one system has the subspace, else 0).

    A system that lacks a subspace has size 0.
    """
    n = len(paths)
    rows = spark.read.parquet(*paths).groupBy("sub_level").agg(F.count(F.lit(1)).alias("k"), F.min("n_points").alias("low"), F.max("n_points").alias("high"), F.sum("n_points").alias("all"))
    size = {"min": F.when(F.col("k") == n, F.col("low")).otherwise(0), "max": F.col("high"), "shared": F.when(F.col("all") > F.col("high"), F.col("high")).otherwise(0)}[how]
    return rows.select("sub_level", size.alias("n_points"))


def write_min_max(df: DataFrame, path: str) -> None:
    """Least and largest coefficients as CSV, the level as text."""
    df.withColumn("sub_level", F.array_join(F.col("sub_level").cast("array<string>"), " ")).write.mode("overwrite").option("header", True).csv(path)


def write_interpolated(df: DataFrame, path: str, per_task: bool = False) -> None:
    """Interpolated values: a folder for each task, or all together. ``sim_time`` goes along as a column."""
    w = df.write.mode("overwrite")
    (w.partitionBy("task_id") if per_task else w).parquet(path)


def write_timers(events: DataFrame, path: str, since_us: int | None = None) -> None:
    """Timer events as JSON lines, all or those that start at or after ``since_us``."""
    (events if since_us is None else events.where(F.col("t_start_us") >= since_us)).write.mode("overwrite").json(path)


TIMERS = "rank int, grp int, event string, t_start_us bigint, t_end_us bigint"


def read_timers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMERS).json(path)


def write_coordinates(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").parquet(path)


def flat_coordinates(points: DataFrame) -> DataFrame:
    """pt_id, d, x: coordinate lists flattened; :func:`nested_coordinates` puts them together again."""
    return points.select("pt_id", F.posexplode("coords").alias("d", "x"))


def nested_coordinates(flat: DataFrame) -> DataFrame:
    return flat.groupBy("pt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("coords"))


def read_load_history(spark: SparkSession, path: str) -> DataFrame:
    """level, load, readings from CSV rows of ``level (blank separated), duration``; rows that can't be read are left out."""
    df = spark.read.schema("level string, duration double").csv(path).where("level IS NOT NULL AND duration IS NOT NULL")
    return df.groupBy("level").agg(F.avg("duration").alias("load"), F.count(F.lit(1)).alias("readings")).withColumn("level", F.transform(F.regexp_extract_all("level", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")))


def write_lines(df: DataFrame, path: str) -> None:
    """One text column, a line per row."""
    df.write.mode("overwrite").text(path)


def write_grid_csv(points: DataFrame, path: str, dim: int) -> None:
    """A grid as CSV: indices, coordinates if there are any, value."""
    cols = [F.get("idx", F.lit(d)).alias(f"i{d}") for d in range(dim)]
    points.select(*cols, "value").write.mode("overwrite").option("header", True).csv(path)


@dataclass(frozen=True)
class CombiConfig:
    """A run's configuration. ``boundary`` is 0, 1 or 2 per dimension; a basis left out follows from it."""

    lmin: list[int]
    lmax: list[int]
    boundary: list[int]
    ncombi: int = 1
    dt: float = 1e-3
    nsteps: int = 1
    bases: list[str] = field(default_factory=list)
    reduce_lmax: list[int] = field(default_factory=list)
    scheme: str | None = None
    groups: int = 1
    chunk_points: int = 1 << 20

    @property
    def dim(self) -> int:
        return len(self.lmax)

    def __post_init__(self) -> None:
        if len(self.lmin) != len(self.lmax) or len(self.boundary) != len(self.lmax) or any(b not in (0, 1, 2) for b in self.boundary):
            raise ValueError("lmin, lmax and boundary must have the same dimensions, boundary 0, 1 or 2")


def read_config(text: str) -> CombiConfig:
    """A configuration from INI text; vectors are blank separated, section names as in ``ct.lmax``."""
    ini = configparser.ConfigParser()
    ini.optionxform = str
    ini.read_string(text)
    get = lambda s, k, default=None: ini.get(s, k, fallback=default)
    ints = lambda v: [int(x) for x in v.split()]
    lmax = ints(get("ct", "lmax", ""))
    return CombiConfig(
        lmin=ints(get("ct", "lmin", "")),
        lmax=lmax,
        boundary=ints(get("ct", "boundary", " ".join("2" for _ in lmax))),
        ncombi=int(get("ct", "ncombi", 1)),
        dt=float(get("application", "dt", 1e-3)),
        nsteps=int(get("application", "nsteps", 1)),
        bases=[get("ct", "basis")] * len(lmax) if get("ct", "basis") else [],
        scheme=get("ct", "ctscheme"),
        groups=int(get("manager", "ngroup", 1)),
    )
