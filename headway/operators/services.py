"""Which services and trips run on a date, and which schedule version is in force."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.operators.search import first_at_least

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def active_services(calendar: DataFrame | None, dates: DataFrame | None, day: dt.date) -> DataFrame:
    """(service_id): the weekly services of the day and its additions, without its removals, which win."""
    on = F.lit(day)
    parts = []
    if calendar is not None:
        parts.append(calendar.filter((F.col(WEEKDAYS[day.weekday()]) == 1) & on.between(F.col("start_date"), F.col("end_date"))).select("service_id"))
    if dates is not None:
        parts.append(dates.filter((F.col("date") == on) & (F.col("exception_type") == 1)).select("service_id"))
    if not parts:
        raise ValueError("neither calendar nor calendar_dates is there")
    rows = parts[0].union(parts[1]) if len(parts) > 1 else parts[0]
    if dates is None:
        return rows.distinct()
    return rows.distinct().join(dates.filter((F.col("date") == on) & (F.col("exception_type") == 2)), "service_id", "left_anti")


def services_by_day(calendar: DataFrame, dates: DataFrame, days: DataFrame) -> DataFrame:
    """(day, service_id) for all of days(day) at once."""
    weekday = F.element_at(F.array(*(F.col(w) for w in WEEKDAYS)), F.weekday("day") + 1)
    weekly = days.join(calendar, F.col("day").between(F.col("start_date"), F.col("end_date"))).filter(weekday == 1).select("day", "service_id")
    at = lambda kind: dates.filter(F.col("exception_type") == kind).select(F.col("date").alias("day"), "service_id")
    return weekly.union(at(1).join(days, "day", "left_semi")).distinct().join(at(2), ["day", "service_id"], "left_anti")


def active_trips(trips: DataFrame, services: DataFrame) -> DataFrame:
    return trips.join(services, "service_id", "left_semi")


def calendar_control(trips: DataFrame, services: DataFrame) -> DataFrame:
    """One row: services active, trips and active trips, and the distinct trips among them."""
    marked = trips.join(services.withColumn("on", F.lit(True)), "service_id", "left")
    return marked.agg(F.countDistinct(F.when(F.col("on"), F.col("service_id"))).alias("services"), F.count("*").alias("trips"), F.count("on").alias("active_trips"), F.countDistinct(F.when(F.col("on"), F.col("trip_id"))).alias("distinct_active_trips"))


def as_of(rows: DataFrame, marks: DataFrame, at: Column, start: Column, keys: tuple[str, ...] = (), width: int = 86400) -> DataFrame:
    """Each row plus `mark`, a struct of the latest of its keys' marks whose start isn't after `at`, null if there is none. at and start are integers; of marks with one start the greatest counts.

    Rows and marks meet by key and slot of `width`: a slot's marks are an ascending array in which a row finds its own by
    halving, and if all of them start later, it has the last mark of the slots before. So a row meets one slot, however
    many marks there are.
    """
    slot = lambda c: F.floor(F.col(c) / width).alias("_slot")
    asked = rows.withColumn("_at", at.cast("long")).withColumn("_slot", slot("_at"))
    named = marks.select(*keys, start.cast("long").alias("_start"), F.struct("*").alias("_mark")).filter("_start IS NOT NULL")
    here = named.select(*keys, slot("_start"), "_start", "_mark").groupBy(*keys, "_slot").agg(F.sort_array(F.collect_list(F.struct("_start", "_mark"))).alias("_here"))
    every = asked.select(*keys, "_slot").distinct().join(here, [*keys, "_slot"], "full")
    last = F.last(F.element_at("_here", -1), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))  # a row a slot
    slots = every.select(*keys, "_slot", F.transform("_here", lambda x: x["_start"]).alias("_starts"), "_here", last["_mark"].alias("_before"))
    n = F.when(F.col("_starts").isNull(), 0).otherwise(first_at_least(F.col("_starts"), F.col("_at") + 1))
    found = asked.join(slots, [*keys, "_slot"], "left").withColumn("mark", F.when(n > 0, F.get("_here", n - 1)["_mark"]).otherwise(F.col("_before")))
    return found.select(*rows.columns, "mark")


def version_as_of(rows: DataFrame, versions: DataFrame, day: str = "service_date", keys: tuple[str, ...] = ()) -> DataFrame:
    """Each row with the version in force on its date: of that day, else the latest before, else null; of versions of one day the last by name counts."""
    one = versions.groupBy(*keys, "valid_from").agg(F.max("version").alias("version"))
    found = as_of(rows, one, F.unix_date(day), F.unix_date("valid_from"), keys, 365)
    return found.select(*rows.columns, "mark.valid_from", "mark.version")


def version_or_first(rows: DataFrame, versions: DataFrame, at: str = "instant") -> DataFrame:
    """Each row with the latest start up to its instant, else the first start of all."""
    first = versions.agg(F.min("start").alias("_first"))  # one row
    found = as_of(rows, versions.select("start").distinct(), F.col(at), F.col("start"))
    return found.join(F.broadcast(first)).select(*rows.columns, F.coalesce("mark.start", "_first").alias("start"))
