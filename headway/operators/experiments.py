"""Inputs of experiments, made from the network: seeded pairs of stops, domains of legs, instances with slack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.operators import search
from headway.operators.multileg import lower_bounds


def origin_destination_pairs(departures: DataFrame, n: int, seed: int, least: int = 3) -> DataFrame:
    """(query_id, origin, destination): n seeded pairs of different stops with `least` departures or more. The same stops and seed give the same pairs, whatever the order of rows."""
    served = departures.groupBy("stop_id").agg(F.count("*").alias("k")).filter(F.col("k") >= least).select("stop_id")
    drawn = lambda salt: served.withColumn("h", F.md5(F.concat_ws("|", F.lit(f"{seed}{salt}"), F.col("stop_id").cast("string")).cast("binary"))).orderBy("h").limit(n + 1)
    numbered = lambda df, name: df.select(F.col("stop_id").alias(name), (F.row_number().over(Window.orderBy("h")) - 1).alias("k"))  # noqa: E731  n + 1 rows
    a, b = numbered(drawn("a"), "origin"), numbered(drawn("b"), "destination")
    after = b.select(F.col("destination").alias("other"), (F.col("k") - 1).alias("k"))
    rows = a.join(b, "k").join(after, "k").withColumn("destination", F.when(F.col("origin") == F.col("destination"), F.col("other")).otherwise(F.col("destination")))
    return rows.filter(F.col("k") < n).select(F.col("k").alias("query_id"), "origin", "destination")


def leg_domains(legs: DataFrame, events: DataFrame, transfers: DataFrame, start: int, end: int, ready: tuple[int, ...]) -> DataFrame:
    """Candidates (instance_id, leg, pos, ready, arrival, transfers, walk_s) of legs(instance_id, leg, origin, destination): the Pareto labels for each time of `ready`, equal ones once."""
    rows = legs.withColumn("instant", F.explode(F.array(*(F.lit(t).cast("long") for t in ready))))
    rows = rows.withColumn("query_id", F.concat_ws("|", F.col("instance_id").cast("string"), F.col("leg").cast("string"), F.col("instant").cast("string")))
    found = search.pareto(rows, events, transfers, start, end).join(rows.select("query_id", "instance_id", "leg", "instant"), "query_id")
    labels = found.groupBy("instance_id", "leg", "arrival", "boardings", "walk_s").agg(F.max("instant").alias("ready"))
    w = Window.partitionBy("instance_id", "leg").orderBy("arrival", "boardings", "walk_s")
    return labels.select("instance_id", "leg", (F.row_number().over(w) - 1).cast("long").alias("pos"), "ready", "arrival", F.col("boardings").cast("long").alias("transfers"), "walk_s")


def feasible_prefix(legs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The legs of each instance before the first one without candidates."""
    empty = legs.join(candidates, ["instance_id", "leg"], "left_anti").groupBy("instance_id").agg(F.min("leg").alias("stop"))
    return legs.join(empty, "instance_id", "left").filter(F.col("stop").isNull() | (F.col("leg") < F.col("stop"))).drop("stop")


def instances_with_slack(legs: DataFrame, candidates: DataFrame, slack_transfers: int, slack_walk_s: int, deadline: int) -> DataFrame:
    """(instance_id, legs, max_transfers, max_walk_s, deadline): budgets are what the legs need at least, plus slack."""
    n = legs.groupBy("instance_id").agg(F.count("*").cast("int").alias("legs"))
    return n.join(lower_bounds(candidates), "instance_id").select("instance_id", "legs", (F.col("min_transfers") + slack_transfers).alias("max_transfers"), (F.col("min_walk_s") + slack_walk_s).alias("max_walk_s"), F.lit(deadline).alias("deadline"))
