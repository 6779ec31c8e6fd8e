"""The queries of this subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dyadica.llm import encode, packing, quantiles, truncation
from dyadica.sources.tables import table


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the durations by group and by task, within 1/1024 of the exact ones."""
    return quantiles.percentiles(table(spark, d, "task_stats"))


def p1_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable summaries by day."""
    return quantiles.summaries(quantiles.readings(table(spark, d, "task_stats")))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode.encode(table(spark, d, "documents"))


def p6_bins(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text, or part of a text, for each target."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_targets"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each target are."""
    targets = table(spark, d, "pack_targets")
    return packing.fill(packing.pack(table(spark, d, "documents"), targets), targets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose text lost its end."""
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p7_sources(spark: SparkSession, d: str) -> DataFrame:
    """The share of truncated texts in each source."""
    return truncation.per_source(table(spark, d, "documents"))


QUERIES = {"p1_percentiles": p1_percentiles, "p1_summaries": p1_summaries, "p5_ids": p5_ids, "p6_bins": p6_bins, "p6_fill": p6_fill, "p7_found": p7_found, "p7_sources": p7_sources}

_READINGS = """
WITH r AS (
  SELECT min(task_id) AS task_id, min(group_no) AS group_no, min(duration_us) AS v, min(CAST(logged_at AS DATE)) AS day FROM task_stats WHERE duration_us IS NOT NULL AND stat_id IS NOT NULL GROUP BY stat_id
  UNION ALL SELECT task_id, group_no, duration_us, CAST(logged_at AS DATE) FROM task_stats WHERE duration_us IS NOT NULL AND stat_id IS NULL),
s AS (SELECT 'task' AS scope, CAST(task_id AS BIGINT) AS key, v, day FROM r WHERE task_id IS NOT NULL
  UNION ALL SELECT 'group', CAST(group_no AS BIGINT), v, day FROM r WHERE group_no IS NOT NULL AND group_no <> -1),
z AS (SELECT *, abs(greatest(v, -9223372036854775807)) AS a, greatest(length(bin(abs(greatest(v, -9223372036854775807)))) - 10, 0) AS sh FROM s)
"""


def _rank(m: int) -> str:
    return f"max(CASE WHEN r = (n * {m} + 999) // 1000 THEN e END)"


ORACLE = {
    "p1_percentiles": _READINGS
    + ", o AS (SELECT scope, key, sign(v) * CASE WHEN sh = 0 THEN a ELSE ((a >> sh) << sh) + (1::BIGINT << (sh - 1)) END AS e, row_number() OVER (PARTITION BY scope, key ORDER BY v) AS r, count(*) OVER (PARTITION BY scope, key) AS n FROM z) "
    + "SELECT scope, key, n, "
    + ", ".join(f"{_rank(m)} AS {q}" for q, m in quantiles.LEVELS.items())
    + " FROM o GROUP BY scope, key, n",
    "p1_summaries": _READINGS + "SELECT scope, key, day, CASE WHEN a < 512 THEN v ELSE sign(v) * (sh * 512 + (a >> sh)) END AS bucket, count(*) AS n FROM z GROUP BY ALL",
}
