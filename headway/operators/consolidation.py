"""From realtime predictions to the observation table: schedule join, provenance, and dedup policies.

Rows carry a total order within a passage (`order` columns), as one dump may repeat a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASSAGE = ("service_date", "trip_id", "stop_sequence")


def with_schedule(predictions: DataFrame, schedule: DataFrame, routes: DataFrame) -> DataFrame:
    """Left joins on (version, trip_id, stop_sequence) and trip; the feed's stop and route win where it has them.

    schedule: version, trip_id, stop_sequence, sched_stop_id, scheduled. routes: trip_id, sched_route_id. Adds
    stop_differs where both sides name a stop and disagree.
    """
    rows = predictions.join(schedule, ["version", "trip_id", "stop_sequence"], "left").join(routes, "trip_id", "left")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    differs = F.coalesce(empty("stop_id") != empty("sched_stop_id"), F.lit(False))
    return rows.withColumns({"stop_differs": differs, "stop_id": F.coalesce(empty("stop_id"), "sched_stop_id", F.lit("")), "route_id": F.coalesce(empty("route_id"), "sched_route_id", F.lit(""))}).drop("sched_stop_id", "sched_route_id")


def with_provenance(rows: DataFrame) -> DataFrame:
    """Fills observed and delay_s from each other and `scheduled`, says how, and drops rows without an observed time.

    observed is synthesised first; the delay is derived only where it is still missing.
    """
    made = F.col("scheduled") + F.col("delay_s")
    observed = F.coalesce("observed", made)
    time_origin = F.when(F.col("observed").isNotNull(), "transmitted").when(made.isNotNull(), "synthesised").otherwise("absent")
    delay_origin = F.when(F.col("delay_s").isNotNull(), "declared").when((observed - F.col("scheduled")).isNotNull(), "derived").otherwise("absent")
    return rows.withColumns({"time_origin": time_origin, "delay_origin": delay_origin, "delay_s": F.coalesce("delay_s", (observed - F.col("scheduled")).cast("int")), "observed": observed}).filter("observed IS NOT NULL")


def change_dedup(rows: DataFrame, order: tuple[str, ...], value: str = "observed", key: tuple[str, ...] = PASSAGE) -> DataFrame:
    """Keeps a passage's first row and those whose value differs from the row before; a return to an old value stays."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    return rows.withColumn("_keep", first | ~before.eqNullSafe(F.col(value))).filter("_keep").drop("_keep")


def last_per_passage(rows: DataFrame, order: tuple[str, ...], key: tuple[str, ...] = PASSAGE) -> DataFrame:
    """A passage's last row, by max_by, so that rows are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def last_before_leads(rows: DataFrame, leads: tuple[int, ...], order: tuple[str, ...], lead: str = "lead_s", key: tuple[str, ...] = PASSAGE) -> DataFrame:
    """The buckets policy: for each threshold the last row whose lead time is at least that, with the threshold as `lead_at_least`."""
    each = rows.withColumn("lead_at_least", F.explode(F.array(*(F.lit(x) for x in leads)))).filter(F.col(lead) >= F.col("lead_at_least"))
    return last_per_passage(each, order, (*key, "lead_at_least"))


def shadow_counters(rows: DataFrame, order: tuple[str, ...], value: str = "observed", key: tuple[str, ...] = PASSAGE) -> DataFrame:
    """One row: how a key without service_date would differ. duplicated: dropped here, kept there; suppressed: kept here, dropped there."""
    short = [k for k in key if k != "service_date"]
    changed = lambda by: (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1) | ~F.lag(value).over(Window.partitionBy(*by).orderBy(*order)).eqNullSafe(F.col(value))
    both = rows.withColumn("a", changed(key)).withColumn("b", changed(short))
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(F.count("*").alias("n_rows"), one(F.col("a")).alias("kept"), one(F.col("a") & ~F.col("b")).alias("suppressed"), one(~F.col("a") & F.col("b")).alias("duplicated"))


def consolidation_summary(rows: DataFrame, kept: Column) -> DataFrame:
    """One row: rows read, rows kept, passages, trips and the part kept."""
    n = F.sum(F.when(kept, 1).otherwise(0))
    return rows.agg(F.count("*").alias("updates"), n.cast("long").alias("kept"), F.countDistinct(*PASSAGE).alias("passages"), F.countDistinct("trip_id").alias("trips"), F.round(F.try_divide(n, F.count("*")), 6).alias("kept_share"))
