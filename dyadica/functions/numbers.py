"""Complex values and sums whose result doesn't depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_fields(points: DataFrame) -> DataFrame:
    """Points with a complex ``value`` struct<re, im> as two real fields each, 2k and 2k + 1: every operator on values is linear."""
    parts = F.array(F.struct((F.col("field_id") * 2).alias("field_id"), F.col("value.re").alias("value")), F.struct((F.col("field_id") * 2 + 1).alias("field_id"), F.col("value.im").alias("value")))
    return points.withColumn("_p", F.explode(parts)).drop("field_id", "value").withColumns({"field_id": F.col("_p.field_id"), "value": F.col("_p.value")}).drop("_p")


def as_complex(points: DataFrame, key: list[str]) -> DataFrame:
    """The inverse of :func:`as_fields`; a part that is missing is null."""
    even = F.col("field_id") % 2 == 0
    both = points.groupBy(*key, F.floor(F.col("field_id") / 2).cast("int").alias("field_id")).agg(F.max(F.when(even, F.col("value"))).alias("re"), F.max(F.when(~even, F.col("value"))).alias("im"))
    return both.select(*key, "field_id", F.struct("re", "im").alias("value"))


def modulus(value: Column) -> Column:
    return F.hypot(value["re"], value["im"])


def stable_sum(value: Column, bits: int = 20) -> Column:
    """A sum in two parts: multiples of 2^-bits, whose sum is exact up to 2^(52 - bits), and the small rests.

    It takes the place of compensated summation, which a shuffle's order would undo.
    """
    high = F.round(value * float(1 << bits)) / float(1 << bits)
    return F.sum(high) + F.sum(value - high)
