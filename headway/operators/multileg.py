"""Trips of several legs under global budgets: one candidate a leg, legs in order, windows, dwell times, budgets.

legs: instance_id, leg, dwell_s, window_from, window_to. candidates: instance_id, leg, pos, ready, arrival, transfers,
walk_s. instances: instance_id, legs, max_transfers, max_walk_s, deadline. Legs count from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_instances(instances: DataFrame, legs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(instance_id, problem): fewer than two legs, a leg without candidates, a window that ends before it begins."""
    few = instances.filter("legs < 2").select("instance_id", F.lit("few_legs").alias("problem"))
    empty = legs.join(candidates, ["instance_id", "leg"], "left_anti").select("instance_id", F.lit("empty_domain").alias("problem"))
    turned = legs.filter("window_to < window_from").select("instance_id", F.lit("inverted_window").alias("problem"))
    return few.union(empty).union(turned).distinct()


def lower_bounds(candidates: DataFrame) -> DataFrame:
    """(instance_id, min_transfers, min_walk_s): sums of each leg's least."""
    return candidates.groupBy("instance_id", "leg").agg(F.min("transfers").alias("t"), F.min("walk_s").alias("w")).groupBy("instance_id").agg(F.sum("t").cast("long").alias("min_transfers"), F.sum("w").cast("long").alias("min_walk_s"))


def violations(assigned: DataFrame, legs: DataFrame, instances: DataFrame) -> DataFrame:
    """(instance_id, violations): the sorted names of what an assignment of one candidate a leg breaks; empty if it is feasible."""
    rows = assigned.join(legs, ["instance_id", "leg"])
    w = Window.partitionBy("instance_id").orderBy("leg")
    rows = rows.withColumn("_free", F.lag(F.col("arrival") + F.col("dwell_s")).over(w))
    early, late = F.col("arrival") < F.col("window_from"), F.col("arrival") > F.col("window_to")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    sums = rows.groupBy("instance_id").agg(any_(early).alias("early"), any_(late).alias("late"), any_(F.col("ready") < F.col("_free")).alias("precedence"), F.sum("transfers").alias("t"), F.sum("walk_s").alias("w"), F.max("arrival").alias("a")).join(instances, "instance_id")
    named = F.array(*(F.when(c, F.lit(n)) for n, c in (("deadline", F.col("a") > F.col("deadline")), ("precedence", F.col("precedence")), ("transfers", F.col("t") > F.col("max_transfers")), ("walk", F.col("w") > F.col("max_walk_s")), ("window_early", F.col("early")), ("window_late", F.col("late")))))
    return sums.select("instance_id", F.array_compact(named).alias("violations"))


def _extended(partial: DataFrame, k: int, candidates: DataFrame, legs: DataFrame) -> DataFrame:
    """Partial assignments with every candidate of leg k that fits so far. partial: instance_id, positions, free, used_t, used_w, last and the budgets."""
    leg = legs.filter(F.col("leg") == k).select("instance_id", "dwell_s", "window_from", "window_to")
    c = candidates.filter(F.col("leg") == k).drop("leg").join(leg, "instance_id")
    rows = partial.filter(F.col("legs") > k).join(c, "instance_id")
    fits = (F.col("ready") >= F.col("free")) & (F.col("window_from").isNull() | (F.col("arrival") >= F.col("window_from"))) & (F.col("window_to").isNull() | (F.col("arrival") <= F.col("window_to")))
    rows = rows.filter(fits & (F.col("used_t") + F.col("transfers") <= F.col("max_transfers")) & (F.col("used_w") + F.col("walk_s") <= F.col("max_walk_s")) & (F.col("arrival") <= F.col("deadline")))
    return rows.withColumn("step_t", F.col("transfers")).withColumn("step_w", F.col("walk_s"))


def _taken(rows: DataFrame, budgets: list[str]) -> DataFrame:
    return rows.select("instance_id", F.concat("positions", F.array(F.col("pos").cast("long"))).alias("positions"), (F.col("arrival") + F.col("dwell_s")).alias("free"), (F.col("used_t") + F.col("step_t")).alias("used_t"), (F.col("used_w") + F.col("step_w")).alias("used_w"), F.col("arrival").alias("last"), *budgets)


_BUDGETS = ["legs", "max_transfers", "max_walk_s", "deadline"]


def _start(instances: DataFrame) -> DataFrame:
    long = lambda x: F.lit(x).cast("long")
    return instances.select("instance_id", F.array().cast("array<bigint>").alias("positions"), long(-(1 << 40)).alias("free"), long(0).alias("used_t"), long(0).alias("used_w"), long(0).alias("last"), *_BUDGETS)


def _most_legs(instances: DataFrame) -> int:
    return instances.agg(F.max("legs")).first()[0] or 1


def greedy(instances: DataFrame, legs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(instance_id, positions, arrival) of instances that taking each leg's best fitting candidate by (arrival, transfers, walk, pos) solves."""
    state, done = _start(instances), None
    for k in range(_most_legs(instances)):
        rows = _extended(state, k, candidates, legs)
        w = Window.partitionBy("instance_id").orderBy("arrival", "transfers", "walk_s", "pos")
        state = _taken(rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1"), _BUDGETS)
        end = state.filter(F.col("legs") == k + 1)
        done = end if done is None else done.union(end)
    return done.select("instance_id", "positions", F.col("last").alias("arrival"))


def complete(instances: DataFrame, legs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(instance_id, positions, arrival): the feasible assignment that arrives first, ties by positions in order.

    Legs are joined one by one. A partial assignment is dropped if the least the other legs need breaks a budget, or if
    another with the same free time and the same uses comes first in order: what it leads to is no better.
    """
    least = candidates.groupBy("instance_id", "leg").agg(F.min("transfers").alias("t"), F.min("walk_s").alias("w"))
    state, done = _start(instances), None
    for k in range(_most_legs(instances)):
        rows = _taken(_extended(state, k, candidates, legs), _BUDGETS)
        need = least.filter(F.col("leg") > k).groupBy("instance_id").agg(F.sum("t").alias("nt"), F.sum("w").alias("nw"))
        rows = rows.join(need, "instance_id", "left").filter("used_t + coalesce(nt, 0) <= max_transfers AND used_w + coalesce(nw, 0) <= max_walk_s").drop("nt", "nw")
        w = Window.partitionBy("instance_id", "free", "used_t", "used_w").orderBy("positions")
        state = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
        end = state.filter(F.col("legs") == k + 1)
        done = end if done is None else done.union(end)
    return done.groupBy("instance_id").agg(F.min(F.struct("last", "positions")).alias("m")).select("instance_id", "m.positions", F.col("m.last").alias("arrival"))


def agreement(instances: DataFrame, greedy_: DataFrame, complete_: DataFrame) -> DataFrame:
    """(instance_id, outcome, same_arrival, greedy_arrival, complete_arrival): both, greedy_fails, unsolvable; and whether both arrive at the same time."""
    rows = instances.select("instance_id").join(greedy_.select("instance_id", F.col("arrival").alias("greedy_arrival")), "instance_id", "left").join(complete_.select("instance_id", F.col("arrival").alias("complete_arrival")), "instance_id", "left")
    g, c = F.col("greedy_arrival"), F.col("complete_arrival")
    outcome = F.when(c.isNull(), "unsolvable").when(g.isNull(), "greedy_fails").otherwise("both")
    return rows.select("instance_id", outcome.alias("outcome"), F.coalesce(g == c, F.lit(False)).alias("same_arrival"), "greedy_arrival", "complete_arrival")


def outcome_table(rows: DataFrame, *keys: str) -> DataFrame:
    """Greedy against complete choices by keys, with a line for every prefix of the keys and one for all (their keys null). rows: from `agreement`, with the keys."""
    g, c = F.col("greedy_arrival"), F.col("complete_arrival")
    lines = rows.rollup(*keys).agg(F.count("*").alias("n"), F.count(c).alias("solvable"), F.count(g).alias("greedy_solves"), F.count(F.when(F.col("same_arrival"), 1)).alias("same_arrival"), F.round(F.avg(g - c), 6).alias("later_s"))
    return lines.withColumn("greedy_share", F.round(F.try_divide("greedy_solves", "solvable"), 6))
