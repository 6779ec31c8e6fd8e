"""The feature state kept up to date by a stream of signed deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dyadica.operators.features import KEYS, apply_deltas
from dyadica.session import children, remove

DELTAS = "entity int, type_id int, weight bigint, length bigint, end bigint, flagged boolean"
EVENT = [*KEYS, "length", "end", "flagged"]
#: Folders by entity that the log of each batch is laid out in, so that only those of touched entities are read again.
SHELVES = 64
#: Batches after which the log is added up to one table of surviving events.
COMPACT = 16


class FeatureStore:
    """A state table and a log of deltas in a shared folder.

    Each batch is appended to the log under its number and the state is written as a new version, so a batch
    that is run again after a failure replaces what it wrote before, and never counts twice. A store that is opened on a
    folder goes on from its newest version that was written to the end. Batches come in rising order, as a stream has them.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version = max(self._whole("state"), default=None)
        self.base = max((b for b in self._whole("base") if self.version is not None and b <= self.version), default=None)

    def _whole(self, kind: str) -> list[int]:
        """The numbers of the tables of a kind that have the mark Spark writes last."""
        of = [n for n in children(self.spark, self.folder) if n.startswith(f"{kind}-")]
        return [int(n.rsplit("-", 1)[1]) for n in of if "_SUCCESS" in children(self.spark, f"{self.folder}/{n}")]

    def _path(self, kind: str, number: int | None) -> str:
        return f"{self.folder}/{kind}-{number}"

    def state(self) -> DataFrame | None:
        return None if self.version is None else self.spark.read.parquet(self._path("state", self.version))

    def _log(self, upto: int) -> DataFrame:
        """The batches since the last table of survivors, and that table."""
        numbers = [b for b in self._whole("batch") if b <= upto and (self.base is None or b > self.base)]
        paths = [self._path("batch", b) for b in sorted(numbers)] + ([self._path("base", self.base)] if self.base is not None else [])
        parts = [self.spark.read.schema(f"{DELTAS}, shelf int").option("basePath", p).parquet(p) for p in paths]
        out = self.spark.createDataFrame([], f"{DELTAS}, shelf int")
        for p in parts:
            out = out.unionByName(p)
        return out

    def survivors(self, shelves: list[int] | None = None, upto: int | None = None) -> DataFrame:
        """The events that have not been retracted: those whose weights add up to more than 0; of some shelves alone if they are named."""
        upto = self.version if upto is None else upto
        log = self._log(-1 if upto is None else upto)
        if shelves is not None:
            log = log.where(F.col("shelf").isin(shelves))
        return log.groupBy(*EVENT).agg(F.sum("weight").alias("weight")).where("weight > 0")

    def _write(self, df: DataFrame, kind: str, number: int) -> None:
        shelf = F.pmod(F.xxhash64("entity"), F.lit(SHELVES)).cast("int")
        df.select(*EVENT, "weight").withColumn("shelf", shelf).repartition("shelf", F.pmod(F.xxhash64(*EVENT), F.lit(8))).write.mode("overwrite").partitionBy("shelf").parquet(self._path(kind, number))

    def put(self, deltas: DataFrame, batch: int) -> None:
        """Apply a batch of deltas; one that has been applied is passed over."""
        if self.version is not None and batch <= self.version:
            return
        self._write(deltas, "batch", batch)
        kept = self.spark.read.schema(f"{DELTAS}, shelf int").option("basePath", self._path("batch", batch)).parquet(self._path("batch", batch))
        taken = [r[0] for r in kept.where("weight < 0").select("shelf").distinct().collect()]  # SHELVES at most
        apply_deltas(self.state(), kept.drop("shelf"), self.survivors(taken, batch).drop("weight")).write.mode("overwrite").parquet(self._path("state", batch))
        before, self.version = self.version, batch
        if len([b for b in self._whole("batch") if self.base is None or b > self.base]) >= COMPACT:
            self._write(self.survivors(), "base", batch)
            self.base = batch
        self._tidy(before)

    def _tidy(self, before: int | None) -> None:
        """Drop what neither this version nor the one before it needs."""
        for kind, needed in (("state", before), ("batch", None if self.base is None else self.base + 1), ("base", self.base)):
            for n in self._whole(kind):
                if needed is not None and n < needed:
                    remove(self.spark, self._path(kind, n))

    def follow(self, arriving: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply a streaming frame of deltas, batch by batch, until what has arrived is done."""
        return arriving.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
