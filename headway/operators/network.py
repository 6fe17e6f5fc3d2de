"""The time-expanded network as DataFrames: events of a window, their order, sizes, speeds, recoveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.operators.quantiles import exact_quantiles
from headway.operators.state import checkpointed

#: Seconds by which the window is widened on both sides for events that lead in or out.
MARGIN_S = 3600


def events(stop_times: DataFrame, start: int, end: int) -> DataFrame:
    """(trip_id, seq, stop_id, arrival, departure, next_seq) of the window widened by MARGIN_S; next_seq is null at a trip's last event.

    The window filter is on the raw seconds, so it reaches the scan.
    """
    inside = stop_times.filter((F.col("departure") >= start - MARGIN_S) & (F.col("arrival") <= end + MARGIN_S))
    after = F.lead("seq").over(Window.partitionBy("trip_id").orderBy("seq"))
    return inside.select("trip_id", "seq", "stop_id", "arrival", "departure", after.alias("next_seq"))


def events_on(stop_times: DataFrame, trips: DataFrame, services: DataFrame, start: int, end: int) -> DataFrame:
    """`events` of the trips that run with one of the services(service_id), as `services.active_services` gives them for a date."""
    running = trips.join(services, "service_id", "left_semi").select("trip_id")
    return events(stop_times.join(running, "trip_id", "left_semi"), start, end)


def departures_index(events_: DataFrame, start: int, end: int) -> DataFrame:
    """(stop_id, place, trip_id, seq, departure): a stop's departures inside the window, in order of time, ties by trip and place."""
    w = Window.partitionBy("stop_id").orderBy("departure", "trip_id", "seq")
    return events_.filter(F.col("departure").between(start, end)).select("stop_id", F.row_number().over(w).alias("place"), "trip_id", "seq", "departure")


def network_size(events_: DataFrame, transfers: DataFrame, start: int, end: int) -> DataFrame:
    """One row: events, on-board, alighting and boarding edges, transfer edges."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    board = F.col("departure").between(start, end) & F.col("next_seq").isNotNull()
    sizes = events_.agg(F.count("*").alias("events"), n(F.col("next_seq").isNotNull()).alias("on_board"), n(F.col("arrival") <= end).alias("alight"), n(board).alias("board"))
    return sizes.join(F.broadcast(transfers.agg(F.count("*").alias("transfers"))))  # one row each


def edges(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """(trip_id, seq, seconds, metres, kmh) of consecutive known stops of a trip that lie apart and take time."""
    at = stop_times.join(stops.select("stop_id", "x_m", "y_m"), "stop_id")
    w = Window.partitionBy("trip_id").orderBy("seq")
    rows = at.select("trip_id", "seq", (F.col("arrival") - F.lag("departure").over(w)).alias("seconds"), (F.col("x_m") - F.lag("x_m").over(w)).alias("dx"), (F.col("y_m") - F.lag("y_m").over(w)).alias("dy"))
    rows = rows.withColumn("metres", F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))).filter("seconds > 0 AND metres > 0")
    return rows.select("trip_id", "seq", "seconds", "metres", (F.col("metres") / F.col("seconds") * 3.6).alias("kmh"))


def speed_distribution(edges_: DataFrame, limit_kmh: float = 150.0) -> DataFrame:
    """One row: edges, largest speed, percentiles 50, 90, 99 and 99.9, edges above the limit."""
    speeds = checkpointed(edges_.select("kmh"))  # each pass of the quantiles reads it
    q = exact_quantiles(speeds, "kmh", (0.5, 0.9, 0.99, 0.999))
    out = speeds.agg(F.count("*").alias("n"), F.max("kmh").alias("m"), F.sum(F.when(F.col("kmh") > limit_kmh, 1).otherwise(0)).cast("long").alias("above"))
    return out.select("n", F.round("m", 6).alias("max_kmh"), *(F.round(F.lit(x).cast("double"), 6).alias(c) for x, c in zip(q, ("p50", "p90", "p99", "p999"))), "above")


#: Seconds of departures that a group of the sweep holds.
SLOT_S = 900


def recoveries(stop_times: DataFrame, trips: DataFrame, legs: DataFrame, k: int = 2) -> DataFrame:
    """(leg_id, rank, trip_id, departure, arrival): for each leg, the next k departures of its route from its stop that reach its alighting stop.

    legs: leg_id, route_id, board_stop, alight_stop, departure. A trip counts with its first alighting after boarding.

    A sweep: the departures of a way (route, stop, alighting stop) are dealt into slots of time. Within a slot they are
    sorted together with the legs, and a leg reads off the chain of the departure behind it; what a slot lacks comes from
    the first chain of the slots behind it. No leg meets more than k departures, so the work goes with legs and departures.
    """
    way = ("route_id", "board_stop", "alight_stop")
    slot = lambda c: F.floor(F.col(c) / SLOT_S).alias("slot")
    on = stop_times.join(trips.select("trip_id", "route_id"), "trip_id")
    board = on.select("trip_id", "route_id", F.col("stop_id").alias("board_stop"), F.col("seq").alias("board_seq"), F.col("departure").alias("dep")).join(legs.select(*way).distinct(), ["route_id", "board_stop"])
    there = on.select("trip_id", F.col("stop_id").alias("alight_stop"), F.col("seq").alias("alight_seq"), "arrival")
    rides = board.join(there, ["trip_id", "alight_stop"]).filter("alight_seq > board_seq").groupBy(*way, "trip_id", "board_seq").agg(F.min(F.struct("alight_seq", "dep", "arrival")).alias("m"))
    rides = rides.select(*way, slot("m.dep"), F.col("m.dep").alias("dep"), "trip_id", "board_seq", F.col("m.arrival").alias("arrival"))
    order = ("dep", "trip_id", "board_seq")
    inside = Window.partitionBy(*way, "slot").orderBy(*order).rowsBetween(0, k - 1)
    rides = checkpointed(rides.withColumn("chain", F.collect_list(F.struct("dep", "trip_id", "arrival")).over(inside)))  # the k departures from each on
    # the k departures from each slot on, and behind each slot that a leg asks about
    by_slot = Window.partitionBy(*way).orderBy("slot")
    heads = rides.groupBy(*way, "slot").agg(F.min_by("chain", F.struct(*order)).alias("head"))
    heads = heads.withColumn("head", F.slice(F.flatten(F.collect_list("head").over(by_slot.rowsBetween(0, k - 1))), 1, k))
    asked = legs.select("leg_id", *way, slot("departure"), "departure")
    slots = heads.unionByName(asked.select(*way, "slot").distinct(), allowMissingColumns=True).groupBy(*way, "slot").agg(F.first("head", ignorenulls=True).alias("head"))
    behind = slots.select(*way, "slot", F.first("head", ignorenulls=True).over(by_slot.rowsBetween(1, Window.unboundedFollowing)).alias("rest"))
    # backwards in time, legs before departures of the same second, as those don't lie behind them
    both = asked.select(*way, "slot", F.col("departure").alias("dep"), "leg_id").unionByName(rides.drop("arrival"), allowMissingColumns=True)
    back = Window.partitionBy(*way, "slot").orderBy(F.desc("dep"), F.col("leg_id").isNull(), F.desc("trip_id"), F.desc("board_seq")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("next", F.last("chain", ignorenulls=True).over(back)).filter("leg_id IS NOT NULL").join(behind, [*way, "slot"])
    none = F.array().cast(dict(rides.dtypes)["chain"])
    chain = F.slice(F.concat(F.coalesce("next", none), F.coalesce("rest", none)), 1, k)
    return found.select("leg_id", F.posexplode(chain).alias("rank", "c")).select("leg_id", (F.col("rank") + 1).alias("rank"), F.col("c.trip_id").alias("trip_id"), F.col("c.dep").alias("departure"), F.col("c.arrival").alias("arrival"))
