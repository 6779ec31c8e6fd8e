"""The queries over general problems of data processing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadica.operators import features, intervals, spikes
from dyadica.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The gaps between the covered times of each process."""
    return intervals.gaps(table(spark, d, "timer_events"), ["rank"], "t_start_us", "t_end_us", names=("gap_start_us", "gap_end_us"))


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    """The continuous periods of each process, with its group; null where ``rank_attributes`` lacks the process."""
    out = intervals.periods(table(spark, d, "timer_events"), ["rank"], "t_start_us", "t_end_us", names=("period_start_us", "period_end_us"))
    groups = table(spark, d, "rank_attributes").where("rank IS NOT NULL").groupBy("rank").agg(F.min("grp").alias("grp"))
    return out.join(groups, "rank", "left").select("rank", "grp", "period_start_us", "period_end_us", "n_rows")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The readings that do not fit their own task."""
    return spikes.implausible(table(spark, d, "task_stats")).select("stat_id")


def p4_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per process group: counts, totals and recency of every event type, over all processes and over managing ones."""
    types = table(spark, d, "event_types")
    attributes = table(spark, d, "rank_attributes")
    events = table(spark, d, "timer_events")
    deltas, survivors = features.timer_deltas(events, attributes, types)
    state = features.apply_deltas(None, deltas, survivors)
    ids = [r[0] for r in types.select("event_type_id").where("event_type_id IS NOT NULL").distinct().orderBy("event_type_id").limit(features.MAX_TYPES + 1).collect()]
    groups = attributes.select(F.col("grp").alias("entity")).where("entity >= 0").distinct().unionByName(state.select("entity").distinct())
    return features.wide(state, groups, ids, "grp")


QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods, "p3_found": p3_found, "p4_features": p4_features}

_COVER = """
WITH x AS (SELECT rank, t_start_us AS s, t_end_us AS e FROM timer_events WHERE rank IS NOT NULL AND t_end_us > t_start_us),
y AS (SELECT rank, s, e, max(e) OVER (PARTITION BY rank ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x)
"""


def _features_sql(ids: range = range(1, 354)) -> str:
    cells = []
    for i in ids:
        c = f"c[{i}]"
        cells.append(
            f"coalesce({c}.n, 0) AS n_{i}, coalesce({c}.total, 0) AS total_{i}, latest - {c}.last AS since_{i}, "
            f"coalesce({c}.n_f, 0) AS n_mgr_{i}, coalesce({c}.total_f, 0) AS total_mgr_{i}, latest - {c}.last_f AS since_mgr_{i}"
        )
    return rf"""
WITH once AS (SELECT DISTINCT rank, grp, event, t_start_us, t_end_us FROM timer_events WHERE t_end_us > t_start_us),
names AS (SELECT trim(lower(regexp_replace(event, '[\s_\-]+', ' ', 'g'))) AS name, min(event_type_id) AS tid FROM event_types GROUP BY 1),
procs AS (SELECT rank, min(grp) AS own, bool_or(coalesce(lower(trim(group_manager)) IN ('1', '01', 'true', 't', 'yes', 'y'), false)) AS mgr FROM rank_attributes GROUP BY 1),
ev AS (SELECT coalesce(own, CASE WHEN grp >= 0 THEN grp END) AS g, coalesce(tid, -1) AS tid, t_end_us - t_start_us AS len, t_end_us AS e, coalesce(mgr, false) AS f
  FROM once LEFT JOIN procs USING (rank) LEFT JOIN names ON name = trim(lower(regexp_replace(event, '[\s_\-]+', ' ', 'g')))),
state AS (SELECT g, tid, count(*) AS n, sum(len) AS total, max(e) AS last, count(*) FILTER (f) AS n_f, coalesce(sum(len) FILTER (f), 0) AS total_f, max(e) FILTER (f) AS last_f FROM ev WHERE g IS NOT NULL GROUP BY 1, 2),
grps AS (SELECT DISTINCT grp AS g FROM rank_attributes WHERE grp >= 0 UNION SELECT DISTINCT g FROM state),
full_ AS (SELECT grps.g AS grp, i, (SELECT max(last) FROM state WHERE state.g = grps.g) AS latest FROM grps, range(1, {ids.stop}) t(i)),
rows_ AS (SELECT full_.grp, latest, list(CASE WHEN n IS NULL THEN NULL ELSE {{'n': n, 'total': CAST(total AS BIGINT), 'last': last, 'n_f': n_f, 'total_f': CAST(total_f AS BIGINT), 'last_f': last_f}} END ORDER BY i) AS c
  FROM full_ LEFT JOIN state ON state.g = full_.grp AND state.tid = full_.i GROUP BY 1, 2)
SELECT grp, latest AS latest_end_us, {", ".join(cells)} FROM rows_"""


ORACLE = {
    "p2_found": _COVER + "SELECT rank, p AS gap_start_us, s AS gap_end_us FROM y WHERE s > p",
    "p2_periods": _COVER
    + """, z AS (SELECT rank, s, e, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY rank ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM y)
SELECT z.rank, a.grp, min(s) AS period_start_us, max(e) AS period_end_us, count(*) AS n_rows FROM z LEFT JOIN (SELECT rank, min(grp) AS grp FROM rank_attributes GROUP BY rank) a ON a.rank = z.rank GROUP BY z.rank, a.grp, k""",
    "p4_features": _features_sql(),
}
