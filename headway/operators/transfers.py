"""Transfers between stops: candidates by grid, default rules by priority, accessibility, integrity, closure.

Pairs come from an equi-join on grid cells, never from all pairs; each rule is a join, a semi- or an anti-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.geo import BANDS, cell, distance2, walk_seconds
from headway.operators.graphs import reachable
from headway.operators.state import checkpointed, stored


@dataclass(frozen=True)
class Rules:
    """Seconds for a change within a station and the margin on walks; the longest walk for wheelchairs; the largest plausible number of walking transfers of a stop."""

    station_s: int = 180
    walk_margin_s: int = 60
    wheelchair_walk_s: int = 180
    most_walks: int = 40
    bands: tuple = BANDS

    @property
    def side(self) -> int:
        """Cell size: the longest band, so neighbours lie in adjacent cells."""
        return max(m for m, _ in self.bands)


def _ends(stops: DataFrame, prefix: str) -> DataFrame:
    return stops.select(F.col("stop_id").alias(f"{prefix}_stop_id"), F.col("x_m").alias(f"{prefix}_x"), F.col("y_m").alias(f"{prefix}_y"))


#: Stops that a part of a cell or a station holds, about.
PART = 2048


def _met(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """left joined with right on a key; where many of right's rows share one, they are dealt into parts, each of which meets left's rows: a dense key is the work of as many tasks as it has parts."""
    size = right.groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts")).filter("_parts > 1")
    right = right.join(size, [*key], "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*right.columns), F.col("_parts"))).cast("int")).drop("_parts")
    left = left.join(size, [*key], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*key, "_part"]).drop("_part")


def candidates_grid(stops: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(from_stop_id, to_stop_id, d2) of different stops in the same or adjacent cells: one side is repeated for its nine cells, then an equi-join. Dense cells are dealt into parts by their number of stops."""
    step = lambda: F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    a = _ends(stops, "from").withColumn("di", step()).withColumn("dj", step())
    a = a.withColumn("i", cell(F.col("from_x"), rules.side) + F.col("di")).withColumn("j", cell(F.col("from_y"), rules.side) + F.col("dj"))
    b = _ends(stops, "to").withColumn("i", cell(F.col("to_x"), rules.side)).withColumn("j", cell(F.col("to_y"), rules.side))
    pairs = _met(a, b, "i", "j").filter("from_stop_id <> to_stop_id")
    return pairs.select("from_stop_id", "to_stop_id", distance2(F.col("from_x"), F.col("from_y"), F.col("to_x"), F.col("to_y")).alias("d2"))


def walks(stops: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(from_stop_id, to_stop_id, walk_s) within the last band."""
    return candidates_grid(stops, rules).withColumn("walk_s", walk_seconds(F.col("d2"), rules.bands)).filter("walk_s IS NOT NULL").drop("d2")


def same_station(stops: DataFrame) -> DataFrame:
    """Ordered pairs of different stops of one station."""
    inside = stops.filter("parent_station IS NOT NULL").select("stop_id", F.col("parent_station").cast("string").alias("p")).filter("p <> ''")
    return _met(inside.withColumnRenamed("stop_id", "from_stop_id"), inside.withColumnRenamed("stop_id", "to_stop_id"), "p").filter("from_stop_id <> to_stop_id").select("from_stop_id", "to_stop_id")


def declared_transfers(declared: DataFrame) -> DataFrame:
    """One time a pair of those with a time: the longest, which is the safe one."""
    return declared.filter("min_transfer_time IS NOT NULL").groupBy("from_stop_id", "to_stop_id").agg(F.max("min_transfer_time").alias("declared_s"))


#: More than the span of an int, so that a level and a time are one number.
_LEVEL = 1 << 33


def min_transfer_times(stops: DataFrame, declared: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(from_stop_id, to_stop_id, min_transfer_time, walk_s, source): declared beats station beats walking; both ends are stops.

    walk_s stays where a higher rule wins. The grid is joined once: one aggregate takes the best rule and the walk of a pair.
    """
    level = lambda df, k, t, walk: df.select("from_stop_id", "to_stop_id", F.lit(k).alias("level"), t.cast("int").alias("t"), walk.cast("int").alias("walk_s"))
    none = F.lit(None)
    rows = level(declared_transfers(declared), 1, F.col("declared_s"), none).union(level(same_station(stops), 2, F.lit(rules.station_s), none)).union(level(walks(stops, rules), 3, F.col("walk_s") + rules.walk_margin_s, F.col("walk_s")))
    # (level, t) as one number, as a least struct would have all pairs sorted
    best = rows.groupBy("from_stop_id", "to_stop_id").agg(F.min(F.col("level") * F.lit(_LEVEL) + F.col("t")).alias("m"), F.max("walk_s").alias("walk_s"))
    best = best.withColumn("level", F.floor((F.col("m") + _LEVEL // 2) / _LEVEL).cast("int")).withColumn("t", (F.col("m") - F.col("level") * F.lit(_LEVEL)).cast("int"))
    ends = stops.select("stop_id")
    for side in ("from_stop_id", "to_stop_id"):
        best = best.join(ends.withColumnRenamed("stop_id", side), side, "left_semi")
    return best.select("from_stop_id", "to_stop_id", F.col("t").alias("min_transfer_time"), "walk_s", F.element_at(F.array(*map(F.lit, ("declared", "station", "walk"))), F.col("level")).alias("source"))


def useful(transfers: DataFrame, serves: DataFrame) -> DataFrame:
    """Pairs after which a route can be boarded that doesn't serve the first stop. serves: (route_id, stop_id).

    One such route is enough, and if the second stop has more routes than the first there is one. So a pair is tried with
    one route of its second stop, then, as long as that settles nothing, with eight times as many of the others.
    """
    per = Window.partitionBy("stop_id")
    place = F.row_number().over(per.orderBy(F.xxhash64("route_id"), "route_id"))
    s = stored(serves.distinct().select("stop_id", "route_id", place.alias("place"), F.count("*").over(per).alias("n")))
    at = s.select(F.col("stop_id").alias("from_stop_id"), "route_id", F.col("n").alias("has"))
    rest, found, tried, more = transfers.select("from_stop_id", "to_stop_id").distinct(), None, 0, 1
    while True:
        some = s.filter(F.col("place").between(tried + 1, tried + more)).select(F.col("stop_id").alias("to_stop_id"), "route_id", "n")
        met = rest.join(some, "to_stop_id").join(at, ["from_stop_id", "route_id"], "left")
        met = met.select("from_stop_id", "to_stop_id", "n", (F.col("has").isNull() | (F.col("n") > F.col("has"))).alias("useful"))
        if more > 1:
            met = met.groupBy("from_stop_id", "to_stop_id").agg(F.max("n").alias("n"), F.max("useful").alias("useful"))
        met = stored(met)
        new = met.filter("useful").select("from_stop_id", "to_stop_id")
        found = new if found is None else found.unionAll(new)
        tried, more = tried + more, more * 8
        rest = met.filter(~F.col("useful") & (F.col("n") > tried)).select("from_stop_id", "to_stop_id")
        if rest.isEmpty():
            return found


def accessible_stops(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """(stop_id): wheelchair 1, or 0 in a station with 1. stations: (stop_id, wheelchair)."""
    up = stations.select(F.col("stop_id").cast("string").alias("p"), F.col("wheelchair").alias("up"))
    rows = stops.withColumn("p", F.col("parent_station").cast("string")).join(up, "p", "left")
    return rows.filter((F.col("wheelchair") == 1) | ((F.col("wheelchair") == 0) & (F.col("up") == 1))).select("stop_id").distinct()


def accessible(transfers: DataFrame, stops_ok: DataFrame, lifts_out: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Pairs between accessible stops, without long walks and ends whose lift is out of service."""
    rows = transfers.filter(F.coalesce(F.col("walk_s") <= rules.wheelchair_walk_s, F.lit(True))).select("from_stop_id", "to_stop_id")
    for side in ("from_stop_id", "to_stop_id"):
        rows = rows.join(stops_ok.withColumnRenamed("stop_id", side), side, "left_semi").join(lifts_out.select(F.col("stop_id").alias(side)), side, "left_anti")
    return rows.select("from_stop_id", "to_stop_id")


def violations(stops: DataFrame, stations: DataFrame, transfers: DataFrame, accessible_pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(rule, stop_id, detail): V1 too many walking transfers, V2 shorter than the walk, V3 accessible platform in an inaccessible station, V4 not positive."""
    row = lambda df, rule, stop, detail: df.select(F.lit(rule).alias("rule"), stop.cast("string").alias("stop_id"), detail.cast("long").alias("detail"))
    degree = transfers.filter("walk_s IS NOT NULL").groupBy("from_stop_id").agg(F.count("*").alias("n")).filter(F.col("n") > rules.most_walks)
    shut = stations.filter("wheelchair = 2").select(F.col("stop_id").cast("string").alias("p"))
    platforms = stops.withColumn("p", F.col("parent_station").cast("string")).join(shut, "p", "left_semi")
    v3 = platforms.join(accessible_pairs.select(F.col("from_stop_id").alias("stop_id")).distinct(), "stop_id", "left_semi")
    return (
        row(degree, "V1", F.col("from_stop_id"), F.col("n"))
        .union(row(transfers.filter("min_transfer_time < walk_s"), "V2", F.col("from_stop_id"), F.col("min_transfer_time")))
        .union(row(v3, "V3", F.col("stop_id"), F.lit(2)))
        .union(row(transfers.filter("min_transfer_time <= 0"), "V4", F.col("from_stop_id"), F.col("min_transfer_time")))
    )


class InconsistentTransfers(ValueError):
    """The integrity rules don't hold."""


def transfer_table(stops: DataFrame, stations: DataFrame, declared: DataFrame, serves: DataFrame, lifts_out: DataFrame, rules: Rules = Rules(), check: bool = True) -> DataFrame:
    """(from_stop_id, to_stop_id, min_transfer_time, on_foot, accessible, useful). With `check`, a violation is an error that names the rules."""
    t = checkpointed(min_transfer_times(stops, declared, rules))  # read by each rule and flag
    ok = accessible(t, accessible_stops(stops, stations), lifts_out, rules)
    if check and (found := violations(stops, stations, t, ok, rules).groupBy("rule").count().orderBy("rule").collect()):
        raise InconsistentTransfers(", ".join(f"{r.rule}: {r['count']}" for r in found))
    rows = t.join(ok.withColumn("accessible", F.lit(True)), ["from_stop_id", "to_stop_id"], "left").join(useful(t, serves).withColumn("useful", F.lit(True)), ["from_stop_id", "to_stop_id"], "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("from_stop_id", "to_stop_id", "min_transfer_time", F.col("walk_s").isNotNull().alias("on_foot"), no("accessible"), no("useful"))


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_stop_id, to_stop_id) reachable from seeds(stop_id) over edges, each seed from itself."""
    pairs = reachable(seeds.select(F.col("stop_id").alias("v")), edges.select(F.col("from_stop_id").alias("a"), F.col("to_stop_id").alias("b")))
    return pairs.select(F.col("source").alias("from_stop_id"), F.col("target").alias("to_stop_id"))


def fact_counts(stops: DataFrame, stations: DataFrame, serves: DataFrame, declared: DataFrame, lifts_out: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(fact, n): how many facts of each kind the rules are given."""
    count = lambda df, fact: df.agg(F.count("*").alias("n")).select(F.lit(fact).alias("fact"), "n")
    cells = stops.select(cell(F.col("x_m"), rules.side), cell(F.col("y_m"), rules.side)).distinct()
    kinds = {"stop": stops, "coordinates": stops.filter("x_m IS NOT NULL AND y_m IS NOT NULL"), "cell": cells, "station": stops.select("parent_station").filter("parent_station IS NOT NULL").distinct(), "access": accessible_stops(stops, stations), "serves": serves, "declared": declared, "lift": lifts_out}
    out = None
    for fact, df in kinds.items():
        out = count(df, fact) if out is None else out.unionAll(count(df, fact))
    return out


def nearest_stops(stops: DataFrame, x: int, y: int, k: int) -> DataFrame:
    """The k stops nearest to a point, ties by stop_id."""
    return stops.withColumn("d2", distance2(F.col("x_m"), F.col("y_m"), F.lit(x), F.lit(y))).orderBy("d2", "stop_id").limit(k)


def central_stop(stops: DataFrame) -> DataFrame:
    """The stop nearest to the mean of all, ties by stop_id: (stop_id, d2)."""
    mean = stops.agg(F.avg("x_m").alias("mx"), F.avg("y_m").alias("my"))  # one row
    d2 = F.round(distance2(F.col("x_m"), F.col("y_m"), F.col("mx"), F.col("my")), 6)
    return stops.join(F.broadcast(mean)).withColumn("d2", d2).agg(F.min(F.struct("d2", "stop_id")).alias("m")).select("m.stop_id", "m.d2")
