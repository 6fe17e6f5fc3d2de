"""Aggregates over observations: delays by hour, rollovers, anomalies, leads, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.operators.quantiles import exact_quantiles
from headway.operators.state import checkpointed


def rounded(c: Column) -> Column:
    """Six decimals, so that the order of a sum doesn't show."""
    return F.round(c, 6)


def delay_summary(rows: DataFrame, *keys: str, value: str = "delay_s") -> DataFrame:
    """n, median, mean, standard deviation, least, quartiles and largest of a value, of all rows or by keys.

    Of all rows, the quartiles are selected by counting (`quantiles`), so no task holds all values.
    """
    v = F.col(value)
    if not keys:
        rows = checkpointed(rows.select(value))  # each pass of the quantiles reads it
    rest = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).cast("double").alias("low"), F.max(v).cast("double").alias("high")]
    if keys:
        q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out, three = rows.groupBy(*keys).agg(*rest, q.alias("q")), [F.col("q")[i] for i in range(3)]
    else:
        out, three = rows.agg(*rest), [F.lit(x).cast("double") for x in exact_quantiles(rows, value, (0.25, 0.5, 0.75))]
    return out.select(*keys, "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), "low", *(rounded(x).alias(c) for x, c in zip(three, ("q1", "median", "q3"))), "high")


def delay_by(rows: DataFrame, *keys: str, value: str = "delay_s") -> DataFrame:
    """n, median, mean and standard deviation by keys."""
    return delay_summary(rows, *keys, value=value).select(*keys, "n", "median", "mean", "std")


def rollover_shares(rows: DataFrame, rollover: Column, large: Column) -> DataFrame:
    """One row: rows, those that look like a rollover, those with a large delay, the trips of each, and large ones left over."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    trips = lambda c: F.countDistinct(F.when(c, F.col("trip_id")))
    return rows.agg(F.count("*").alias("n"), n(rollover).alias("rollover"), n(large).alias("large"), trips(rollover).alias("rollover_trips"), trips(large).alias("large_trips"), n(large & ~rollover).alias("residual"))


def concentration(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    """One row: rows in all, rows of the k keys with most (ties by key), and their share. Keys are counted before they are ranked."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), key).limit(k).agg(F.sum("n").alias("top"))
    return total.join(F.broadcast(top)).select(F.col("total"), F.col("top"), rounded(F.try_divide("top", "total")).alias("share"))


def most_common(rows: DataFrame, value: str, k: int = 8) -> DataFrame:
    """The k most frequent values, ties by value, with their share of all rows."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).orderBy(F.desc("n"), value).limit(k).select(value, "n", rounded(F.col("n") / F.col("total")).alias("share"))


def dispersion(rows: DataFrame, value: str = "delay_s") -> DataFrame:
    """One row: trips of two rows or more, and the medians of their standard deviation, mean and size."""
    trips = checkpointed(rows.groupBy("trip_id").agg(F.stddev_samp(value).alias("std"), F.avg(value).alias("mean"), F.count("*").alias("n")).filter("n > 1"))
    mid = lambda c: rounded(F.lit(exact_quantiles(trips, c, (0.5,))[0]).cast("double"))
    return trips.agg(F.count("*").alias("trips"), mid("std").alias("median_std"), mid("mean").alias("median_mean"), mid("n").alias("median_size"))


def several_dates(rows: DataFrame) -> DataFrame:
    """(trip_id, stop_sequence, dates) of passages observed for more than one service date."""
    return rows.groupBy("trip_id", "stop_sequence").agg(F.countDistinct("service_date").alias("dates")).filter("dates > 1")


def shared_stops(rows: DataFrame, least: int = 3000) -> DataFrame:
    """(mode, n, shared, share, decidable): rows by mode, those at stops that several modes serve, and whether they are enough to judge."""
    modes = rows.groupBy("stop_id").agg(F.countDistinct("mode").alias("modes")).filter("modes > 1").select("stop_id", F.lit(1).alias("several"))
    out = rows.join(modes, "stop_id", "left").groupBy("mode").agg(F.count("*").alias("n"), F.count("several").alias("shared"))
    return out.withColumn("share", rounded(F.col("shared") / F.col("n"))).withColumn("decidable", F.col("shared") >= least)


def stop_ranks(rows: DataFrame) -> DataFrame:
    """(trip_id, stop_sequence, anomalous, rank): a trip's distinct stops in order; a stop is anomalous if any of its rows is."""
    stops = rows.groupBy("trip_id", "stop_sequence").agg(F.max("anomalous").alias("anomalous"))
    return stops.withColumn("rank", F.row_number().over(Window.partitionBy("trip_id").orderBy("stop_sequence")))


def islands(rows: DataFrame) -> DataFrame:
    """(trip_id, stops, anomalous_stops, runs, first_rank, share) of trips with anomalous stops: how many contiguous runs they form."""
    ranked = stop_ranks(rows)
    run = F.col("rank") - F.row_number().over(Window.partitionBy("trip_id", "anomalous").orderBy("rank"))
    by = ranked.withColumn("run", F.when(F.col("anomalous"), run)).groupBy("trip_id")
    out = by.agg(F.count("*").alias("stops"), F.count(F.when(F.col("anomalous"), 1)).alias("anomalous_stops"), F.countDistinct("run").alias("runs"), F.min(F.when(F.col("anomalous"), F.col("rank"))).alias("first_rank"))
    return out.filter("anomalous_stops > 0").withColumn("share", rounded(F.col("anomalous_stops") / F.col("stops")))


def normal_stops_of_anomalous_trips(rows: DataFrame) -> DataFrame:
    """Rows of trips with anomalies at stops without any."""
    bad = rows.filter("anomalous").select("trip_id", "stop_sequence").distinct()
    return rows.join(bad.select("trip_id").distinct(), "trip_id", "left_semi").join(bad, ["trip_id", "stop_sequence"], "left_anti")


def passage_filter(rows: DataFrame) -> DataFrame:
    """Rows that are a passage's last appearance while its trip still appears later. rows: trip_id, stop_sequence, dump."""
    passage, trip = Window.partitionBy("trip_id", "stop_sequence"), Window.partitionBy("trip_id")
    marked = rows.withColumn("_last", F.max("dump").over(passage)).withColumn("_trip", F.max("dump").over(trip))
    return marked.filter((F.col("dump") == F.col("_last")) & (F.col("_last") < F.col("_trip"))).drop("_last", "_trip")


def hourly_both(rows: DataFrame, passed: DataFrame, value: str = "delay_s") -> DataFrame:
    """(hour, n_all, median_all, n_passed, median_passed): rows against those of the passage filter, by hour."""
    by = lambda df, tag: delay_summary(df, "hour", value=value).select("hour", F.col("n").alias(f"n_{tag}"), F.col("median").alias(f"median_{tag}"))
    return by(rows, "all").join(by(passed, "passed"), "hour", "full")


def numbered(rows: DataFrame, order: str, name: str = "k") -> DataFrame:
    """The rows with their place (from 0) in the order of a column of different values.

    They are sorted in ranges, a task each; a row's place is that in its range and the number of rows in those before it.
    """
    ranges = checkpointed(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranges.withColumn("_inside", inside).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name))


def even_blocks(dumps: DataFrame, blocks: int, size: int) -> DataFrame:
    """Of dumps(dump) in order, `size` consecutive ones from each of `blocks` evenly spaced places: (dump, block)."""
    total = dumps.agg(F.count("*").alias("total"))  # one row
    rows = numbered(dumps, "dump").join(F.broadcast(total))
    step = F.greatest(F.lit(size), F.floor(F.col("total") / blocks)).cast("long")
    return rows.withColumn("block", F.floor(F.col("k") / step).cast("long")).filter((F.col("k") % step < size) & (F.col("block") < blocks)).select("dump", "block")


def block_order(trips: DataFrame) -> DataFrame:
    """(block_id, trip_id, place): the trips of a vehicle block by first departure, ties by trip."""
    return trips.withColumn("place", F.row_number().over(Window.partitionBy("block_id").orderBy("first_departure", "trip_id"))).select("block_id", "trip_id", "place")


def block_successors(trips: DataFrame, shifted: DataFrame, ahead: int = 2) -> DataFrame:
    """(trip_id, next_trip_id, step): the next `ahead` trips of the blocks of shifted trips, without shifted ones."""
    order = block_order(trips)
    after = order.select("block_id", F.col("trip_id").alias("next_trip_id"), F.col("place").alias("p"))
    mine = order.join(shifted.select("trip_id").distinct(), "trip_id", "left_semi").withColumn("p", F.explode(F.array(*(F.col("place") + k for k in range(1, ahead + 1)))))
    found = mine.join(after, ["block_id", "p"]).select("trip_id", "next_trip_id", (F.col("p") - F.col("place")).cast("int").alias("step"))
    return found.join(shifted.select(F.col("trip_id").alias("next_trip_id")).distinct(), "next_trip_id", "left_anti").select("trip_id", "next_trip_id", "step")


def coverage(polls: DataFrame, *keys: str) -> DataFrame:
    """Counts by outcome and the part saved or duplicate, 0 for none."""
    n = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)), F.lit(0)).cast("long").alias(o)
    out = polls.groupBy(*keys).agg(n("saved"), n("duplicate"), n("rejected"), n("failed"), F.count("*").alias("polls"))
    return out.withColumn("coverage", rounded(F.coalesce(F.try_divide(F.col("saved") + F.col("duplicate"), F.col("polls")), F.lit(0.0))))


DAY_S = 86400


def gaps(polls: DataFrame, threshold_s: int, keys: tuple[str, ...] = ("city",)) -> DataFrame:
    """(keys, gap_start, gap_end, gap_s): stretches of `threshold_s` or more between one success and the next.

    Days are looked at by themselves; only the first and last success of each meet those of other days.
    """
    ok = polls.filter(F.col("outcome").isin("saved", "duplicate")).select(*keys, "instant", F.floor(F.col("instant") / DAY_S).alias("_day"))
    before = F.lag("instant").over(Window.partitionBy(*keys, "_day").orderBy("instant"))
    within = ok.select(*keys, before.alias("gap_start"), F.col("instant").alias("gap_end"))
    days = ok.groupBy(*keys, "_day").agg(F.min("instant").alias("gap_end"), F.max("instant").alias("_last"))
    between = days.select(*keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day")).alias("gap_start"), "gap_end")
    rows = within.unionByName(between).withColumn("gap_s", F.col("gap_end") - F.col("gap_start"))
    return rows.filter(F.col("gap_s") >= threshold_s)


def real_coverage(polls: DataFrame, interval_s: int, tz: str, keys: tuple[str, ...] = ("city",)) -> DataFrame:
    """(keys, day, successes, coverage, real_coverage): of the polls made, and of those the local day has room for (at most 1)."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("instant"), tz))
    good = F.sum(F.when(F.col("outcome").isin("saved", "duplicate"), 1).otherwise(0)).cast("long")
    out = polls.groupBy(*keys, day.alias("day")).agg(good.alias("successes"), F.count("*").alias("polls"))
    return out.select(*keys, "day", "successes", rounded(F.col("successes") / F.col("polls")).alias("coverage"), rounded(F.least(F.lit(1.0), F.col("successes") * interval_s / 86400.0)).alias("real_coverage"))


def gap_hours(polls: DataFrame, threshold_s: int, tz: str, keys: tuple[str, ...] = ("city",)) -> DataFrame:
    """(keys, day, gaps, hours): by local day on which they begin, the gaps and how long they are in all."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("gap_start"), tz))
    return gaps(polls, threshold_s, keys).groupBy(*keys, day.alias("day")).agg(F.count("*").alias("gaps"), rounded(F.sum("gap_s") / 3600.0).alias("hours"))


def negative_medians(by_hour: DataFrame, *keys: str) -> DataFrame:
    """(keys, hours, negative): of a table by hour with `median`, how many hours there are and in how many it is below zero."""
    return by_hour.groupBy(*keys).agg(F.count("*").alias("hours"), F.coalesce(F.sum(F.when(F.col("median") < 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("negative"))


def absent_trips(rows: DataFrame, timetable: DataFrame, *keys: str) -> DataFrame:
    """(keys, trips, absent, absent_share): of the trips with rows that have no scheduled time, those that the timetable of their keys lacks; it lacks but a stop of the others.

    rows: keys, trip_id, scheduled. timetable: keys, trip_id, repeated rows count once. Null keys are in no timetable.
    """
    on = [*keys, "trip_id"]
    known = timetable.select(*on).distinct().withColumn("_known", F.lit(1))
    missing = rows.filter("scheduled IS NULL").select(*on).distinct().join(known, on, "left")
    out = missing.groupBy(*keys).agg(F.count("*").alias("trips"), (F.count("*") - F.count("_known")).alias("absent"))
    return out.withColumn("absent_share", rounded(F.col("absent") / F.col("trips")))


def examples(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in an order, for a report."""
    return rows.orderBy(*order).limit(n)


def snapshot_dedup(polls: DataFrame, keys: tuple[str, ...] = ("feed",), order: tuple[str, ...] = ("instant",)) -> DataFrame:
    """Polls whose feed timestamp differs from that of the poll saved before; 0 and null always count as new.

    A poll that isn't saved has the timestamp of the one saved before, so the last known one can be read from any row. The
    first of `order` is an instant; days are looked at by themselves and start with what the days before them knew last.
    """
    known = F.when(F.col("feed_ts") != 0, F.col("feed_ts"))
    rows = polls.withColumn("_day", F.floor(F.col(order[0]) / DAY_S)).withColumn("_known", known)
    behind = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*keys, "_day").agg(F.max_by("_known", F.when(F.col("_known").isNotNull(), F.struct(*order))).alias("_end"))
    start = F.last("_end", ignorenulls=True).over(behind(Window.partitionBy(*keys).orderBy("_day")))
    days = days.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_day").alias("_d"), start.alias("_start"))
    same = F.col("_day") == F.col("_d")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    before = F.coalesce(F.last("_known", ignorenulls=True).over(behind(Window.partitionBy(*keys, "_day").orderBy(*order))), F.col("_start"))
    fresh = F.col("_known").isNull() | before.isNull() | (F.col("_known") != before)
    return rows.join(days, same).withColumn("_fresh", fresh).filter("_fresh").select(*polls.columns)


def city_table(rows: DataFrame, *keys: str, measures: tuple[str, ...]) -> DataFrame:
    """Mean and standard deviation of measures by keys; a single row has deviation 0."""
    aggs = []
    for m in measures:
        aggs += [rounded(F.avg(m)).alias(f"{m}_mean"), rounded(F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_std")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)
