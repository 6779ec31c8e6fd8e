"""Per-entity features from events, maintained by signed deltas.

The state has one row per entity and event type: the number of events, their total time and the
last end, over all events and again over flagged ones. A delta row inserts (+) or retracts (-)
events. Counts and totals are sums, so deltas are simply added. A maximum can't be subtracted
from: it is recomputed from the surviving events, but only for the entities and types of which a
retraction takes away the latest event; everywhere else the larger of the two maxima holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadica.session import cut, stored

KEYS = ["entity", "type_id"]
#: Columns of the state besides the keys; a name ending in _f counts flagged events alone.
SUMS = ["n", "total", "n_f", "total_f"]
MAXIMA = ["last", "last_f"]
#: The type of events whose name is not known; it counts for an entity's latest end only.
UNKNOWN = -1
#: Most event types a wide table is made for.
MAX_TYPES = 5000


def summed(deltas: DataFrame) -> DataFrame:
    """Deltas by entity and type, partial sums before the shuffle.

    ``deltas``: entity, type_id, weight (signed number of equal events), length, end, flagged.
    """
    w, flagged = F.col("weight"), F.coalesce(F.col("flagged"), F.lit(False))

    def of(sign: int, flag: bool) -> Column:
        right = (w > 0) if sign > 0 else (w < 0)
        return F.max(F.when(right & flagged if flag else right, F.col("end")))

    return deltas.groupBy(*KEYS).agg(
        F.sum(w).alias("n"),
        F.sum(w * F.col("length")).alias("total"),
        F.sum(F.when(flagged, w).otherwise(0)).alias("n_f"),
        F.sum(F.when(flagged, w * F.col("length")).otherwise(0)).alias("total_f"),
        of(1, False).alias("in_last"),
        of(1, True).alias("in_last_f"),
        of(-1, False).alias("out_last"),
        of(-1, True).alias("out_last_f"),
    )


def apply_deltas(state: DataFrame | None, deltas: DataFrame, survivors: DataFrame) -> DataFrame:
    """The state after ``deltas``; ``survivors`` are the events that remain, looked at only where needed.

    ``state``: None, or entity, type_id, n, total, n_f, total_f, last, last_f.
    ``survivors``: entity, type_id, end, flagged. Rows with a null entity or type belong to no
    feature and are left out. An entity and type whose events are all retracted leave the state.
    Empty deltas leave the state as it is.
    """
    some = F.col("entity").isNotNull() & F.col("type_id").isNotNull()
    new = summed(deltas.where(some))
    if state is not None:
        was = state.select(*KEYS, *SUMS, *[F.col(c).alias(f"was_{c}") for c in MAXIMA])
        d = new.select(*KEYS, *[F.col(c).alias(f"d_{c}") for c in SUMS], *[f"{s}_{c}" for s in ("in", "out") for c in MAXIMA])
        new = was.join(d, KEYS, "full").select(*KEYS, *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in SUMS], *[F.greatest(f"was_{c}", f"in_{c}").alias(f"in_{c}") for c in MAXIMA], *[f"out_{c}" for c in MAXIMA])
    hit = (F.coalesce(F.col("out_last") >= F.col("in_last"), F.lit(False))) | (F.coalesce(F.col("out_last_f") >= F.col("in_last_f"), F.lit(False)))
    new = cut(new.where("n > 0").withColumn("hit", hit))
    again = (
        survivors.join(new.where("hit").select(*KEYS), KEYS, "left_semi")
        .groupBy(*KEYS)
        .agg(F.max("end").alias("re_last"), F.max(F.when(F.col("flagged"), F.col("end"))).alias("re_last_f"))
    )
    if not new.where("hit").isEmpty():
        new = cut(new.join(again, KEYS, "left"))
    else:
        new = new.withColumns({f"re_{c}": F.lit(None).cast("bigint") for c in MAXIMA})
    return new.select(*KEYS, *SUMS, *[F.when(F.col("hit"), F.col(f"re_{c}")).otherwise(F.col(f"in_{c}")).alias(c) for c in MAXIMA])


def wide(state: DataFrame, entities: DataFrame, type_ids: list[int], entity: str) -> DataFrame:
    """One row per entity with six columns per event type, in the order of ``type_ids``.

    ``n_<id>``, ``total_<id>`` and, over flagged events, ``n_mgr_<id>``, ``total_mgr_<id>`` are 0
    where there is none; ``since_<id>``, ``since_mgr_<id>``, the time from the last end to the
    entity's latest end over all its events, are null there. ``entities`` lists the entities to
    appear, with events or without.
    """
    if len(type_ids) > MAX_TYPES:
        raise ValueError(f"{len(type_ids)} event types; a wide table is made for {MAX_TYPES} at most")
    per_type = F.map_from_entries(F.collect_list(F.when(F.col("type_id") != UNKNOWN, F.struct("type_id", F.struct(*SUMS, *MAXIMA)))))  # one entry a type: MAX_TYPES at most
    rows = entities.select("entity").distinct().join(state.groupBy("entity").agg(F.max("last").alias("latest"), per_type.alias("m")), "entity", "left")
    rows = rows.selectExpr("entity", "latest", *[f"m[{i}] AS c{i}" for i in type_ids])
    cells = "coalesce(c{0}.n, 0L) AS n_{0}|coalesce(c{0}.total, 0L) AS total_{0}|latest - c{0}.last AS since_{0}|coalesce(c{0}.n_f, 0L) AS n_mgr_{0}|coalesce(c{0}.total_f, 0L) AS total_mgr_{0}|latest - c{0}.last_f AS since_mgr_{0}"
    return rows.selectExpr(f"entity AS `{entity}`", "latest AS latest_end_us", *[c for i in type_ids for c in cells.format(i).split("|")])


def spelled(name: Column) -> Column:
    """One spelling of an event name: lower case, single blanks for blanks, underscores and hyphens."""
    return F.trim(F.lower(F.regexp_replace(name, r"[\s_\-]+", " ")))


def is_flag(value: Column) -> Column:
    """True for the usual spellings of yes; false for others and null."""
    v = F.lower(F.trim(value.cast("string")))
    return F.coalesce(v.isin("1", "01", "true", "t", "yes", "y"), F.lit(False))


def timer_deltas(events: DataFrame, attributes: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed deltas and surviving events from timer rows.

    Every row received inserts an event; a row that was sent again (equal but for ``flushed_at``)
    also retracts one, so that it counts once. Rows without start or end, or whose end is not
    after the start, are no events. The group is the one that ``attributes`` has for the rank, else the
    row's own unless negative; a row without either has no entity. A row without a rank is of its group
    and of no flagged process. Names are matched however spelled; unknown ones get ``UNKNOWN``.
    """
    from dyadica.operators.skew import lookup_join

    ends = (F.col("t_end_us") > F.col("t_start_us")) & F.col("t_start_us").isNotNull() & F.col("t_end_us").isNotNull()
    rows = events.select("rank", "grp", "event", "t_start_us", "t_end_us").where(ends)
    once = rows.groupBy("rank", "grp", "event", "t_start_us", "t_end_us").agg(F.count(F.lit(1)).alias("copies"))
    names = types.select(spelled(F.col("event")).alias("name"), "event_type_id").where("name IS NOT NULL AND event_type_id IS NOT NULL").groupBy("name").agg(F.min("event_type_id").alias("type_id"))
    procs = attributes.where("rank IS NOT NULL").groupBy("rank").agg(F.min("grp").alias("own"), F.max(is_flag(F.col("group_manager"))).alias("mgr"))
    once = lookup_join(once.withColumn("name", spelled(F.col("event"))).join(names, "name", "left"), procs, ["rank"], counted=events.select("rank"))
    survivors = once.select(
        F.coalesce("own", F.when(F.col("grp") >= 0, F.col("grp"))).alias("entity"),
        F.coalesce("type_id", F.lit(UNKNOWN)).alias("type_id"),
        (F.col("t_end_us") - F.col("t_start_us")).alias("length"),
        F.col("t_end_us").alias("end"),
        F.coalesce("mgr", F.lit(False)).alias("flagged"),
        "copies",
    ).where("entity IS NOT NULL")
    survivors = stored(survivors)  # read for the deltas and again for what is recomputed
    deltas = survivors.withColumn("weight", F.explode(F.filter(F.array(F.col("copies"), 1 - F.col("copies")), lambda w: w != 0)))
    return deltas, survivors
