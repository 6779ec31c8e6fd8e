"""Exchange of sparse grids by files: each arriving folder of Parquet files is a batch of the sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SPARSE = "field_id int, x_key array<bigint>, sub_level array<int>, value double"


def running_sum(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """The sum by key of all sparse grids that arrive in ``folder``, as a streaming aggregation (update or complete mode)."""
    arriving = spark.readStream.schema(SPARSE).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).parquet(folder)
    return arriving.groupBy("field_id", "x_key", "sub_level").agg(F.sum("value").alias("value"))


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the running sum in a memory table; for tests and small front ends."""
    return running_sum(spark, folder).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()


def each_batch(spark: SparkSession, folder: str, checkpoint: str, put) -> StreamingQuery:
    """Call ``put(frame, batch)`` with what each batch of files adds up to; files seen once are not read again."""
    arriving = spark.readStream.schema(SPARSE).option("recursiveFileLookup", True).parquet(folder)

    def add(df: DataFrame, batch: int) -> None:
        put(df.groupBy("field_id", "x_key", "sub_level").agg(F.sum("value").alias("value")), batch)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
