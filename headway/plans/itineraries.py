"""Queries on searches, distributions, choices, multi-leg trips, streams and experiment tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import distributions as dis
from headway.operators import diagnostics as dia
from headway.operators import multileg as mul
from headway.operators import network as net
from headway.operators import reliability as rel
from headway.operators import search as sea
from headway.operators import transfers as tra
from headway.operators.state import checkpointed, shared_dir
from headway.plans import views as v
from headway.plans.catalog import END, START, query
from headway.streaming import realtime as rt

# Searches: every stop to the one numbered before it, which declared transfers lead away from


def _search(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = v.stops(spark, d)
    goals = s.select((F.col("stop_id") + 1).alias("origin"), F.col("stop_id").alias("destination"))
    queries = s.select(F.col("stop_id").alias("query_id"), F.col("stop_id").alias("origin"), F.lit(START).alias("instant")).join(goals, "origin").select("query_id", "origin", "destination", "instant")
    transfers = checkpointed(tra.min_transfer_times(s, v.declared(spark, d)).select("from_stop_id", "to_stop_id", "min_transfer_time"))
    return queries, checkpointed(net.events(v.stop_times(spark, d), START, END)), transfers  # each round reads them


def _search_sql(pareto: bool) -> str:
    """The rounds unrolled. w6 has the shortest ways on foot of up to 64 transfers, of which none takes less than two minutes; r0 to r4 are the states after as many boardings."""
    best = lambda rows: f"SELECT query_id, stop_id, t, w FROM (SELECT *, min(w) OVER (PARTITION BY query_id, stop_id ORDER BY t, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT DISTINCT * FROM ({rows}))) WHERE b IS NULL OR w < b"
    first = lambda rows: f"SELECT query_id, stop_id, min(t) AS t, 0 AS w FROM ({rows}) GROUP BY ALL"
    keep = best if pareto else first
    walk = f"SELECT query_id, b AS stop_id, t + s AS t, w + s AS w FROM {{}} JOIN w6 ON a = stop_id WHERE t + s <= {END}"
    parts = ["q AS (SELECT s.stop_id AS query_id, s.stop_id AS origin, g.stop_id AS destination FROM stops s JOIN stops g ON g.stop_id = s.stop_id - 1)"]
    parts.append("w0 AS MATERIALIZED (SELECT from_stop_id AS a, to_stop_id AS b, CAST(min_transfer_time AS BIGINT) AS s FROM transfers UNION ALL SELECT stop_id, stop_id, 0 FROM stops)")
    parts += [f"w{k} AS MATERIALIZED (SELECT x.a, y.b, min(x.s + y.s) AS s FROM w{k - 1} x JOIN w{k - 1} y ON x.b = y.a WHERE x.s + y.s <= {END - START} GROUP BY ALL)" for k in range(1, 7)]
    parts.append(f"o0 AS (SELECT query_id, origin AS stop_id, {START} AS t, 0 AS w FROM q), r0 AS MATERIALIZED ({keep(walk.format('o0'))})")
    for k in range(1, 5):
        parts.append(f"""b{k} AS (SELECT query_id, trip_id, w, min(seq) AS seq FROM r{k - 1} JOIN network USING (stop_id) WHERE next_seq IS NOT NULL AND departure BETWEEN {START} AND {END} AND departure >= t GROUP BY ALL),
        o{k} AS ({keep(f"SELECT query_id, n.stop_id, n.arrival AS t, w FROM b{k} JOIN network n ON n.trip_id = b{k}.trip_id AND n.seq > b{k}.seq WHERE n.arrival <= {END}")}), r{k} AS MATERIALIZED ({keep(walk.format(f"o{k}"))})""")
    parts.append("found AS (" + " UNION ALL ".join(f"SELECT query_id, t AS arrival, CAST({k} AS INT) AS boardings, w AS walk_s FROM r{k} JOIN q USING (query_id) WHERE stop_id = destination" for k in range(5)) + ")")
    if pareto:
        return ", " + ", ".join(parts) + " SELECT DISTINCT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.query_id = f.query_id AND g.arrival <= f.arrival AND g.boardings <= f.boardings AND g.walk_s <= f.walk_s AND (g.arrival < f.arrival OR g.boardings < f.boardings OR g.walk_s < f.walk_s))"
    return ", " + ", ".join(parts) + " SELECT query_id, arrival, boardings FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY arrival, boardings) = 1"


@query(_search_sql(False), "stops", "transfers", "network")
def earliest_arrival_rounds(spark, d):
    return sea.earliest_arrival(*_search(spark, d), START, END)


@query(_search_sql(True), "stops", "transfers", "network")
def pareto_frontier(spark, d):
    return sea.pareto(*_search(spark, d), START, END)


@query()
def search_paths(spark, d):
    """Each query's earliest way, leg by leg."""
    found = sea.earliest_arrival(*_search(spark, d), START, END, paths=True)
    return found.select("query_id", F.posexplode_outer("legs").alias("leg", "l")).select("query_id", (F.coalesce("leg", F.lit(-1)) + 1).alias("leg"), "l.*")


def _plans(spark, d) -> DataFrame:
    """All labels of the searches as itineraries."""
    asked = _search(spark, d)
    return rel.itineraries(sea.pareto(*asked, START, END, paths=True), asked[0], v.stop_times(spark, d), v.trips(spark, d))


@query()
def planned_itineraries(spark, d):
    legs = F.transform("legs", lambda x: F.concat_ws(":", x["min_transfer_s"].cast("string"), x["route_id"], F.size(x["alternatives"]).cast("string")))
    return _plans(spark, d).select("itinerary_id", "query_id", "pos", "arrival", "transfers", "tail_walk_s", F.concat_ws(",", legs).alias("legs"))


MARGINS = (0, 300, 600, 900, 1200, 1800)


@query()
def deadline_grid(spark, d):
    """By strategy and margin: how likely what it chooses is to arrive in time."""
    return dia.city_table(rel.deadline_grid(_plans(spark, d), MARGINS, dis.Synthetic(), invented=True), "strategy", "margin", measures=("probability",))


@query()
def deadline_gain(spark, d):
    """By margin: what the robust choice gains over the fastest."""
    grid = rel.deadline_grid(_plans(spark, d), MARGINS, dis.Synthetic(), invented=True).filter("strategy IN ('robust', 'fastest')")
    gain = grid.groupBy("query_id", "margin").agg(F.sum(F.when(F.col("strategy") == "robust", F.col("probability")).otherwise(-F.col("probability"))).alias("gain"))
    return dia.city_table(gain, "margin", measures=("gain",))


_LABELS = "SELECT DISTINCT o_custkey AS query_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS arrival, o_orderkey % 4 AS boardings, o_orderkey % 11 * 60 AS walk_s FROM orders"


@query(f"WITH l AS ({_LABELS}) SELECT * FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.query_id = a.query_id AND b.arrival <= a.arrival AND b.boardings <= a.boardings AND b.walk_s <= a.walk_s AND (b.arrival < a.arrival OR b.boardings < a.boardings OR b.walk_s < a.walk_s))")
def dominance_skyline(spark, d):
    k = F.col("o_orderkey")
    rows = v.table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("arrival"), (k % 4).alias("boardings"), (k % 11 * 60).alias("walk_s"))
    return sea.skyline(rows, ("query_id",), ("arrival", "boardings", "walk_s"))


# Distributions


@query("SELECT mode, x, round(count(*) FILTER (WHERE delay_s <= x) / count(*), 6) AS cdf FROM observations, (SELECT unnest(range(-600, 4500, 300)) AS x) GROUP BY mode, x", "observations")
def empirical_cdf(spark, d):
    return rel.empirical_cdf(v.observations(spark, d), "delay_s", spark.range(-600, 4500, 300).withColumnRenamed("id", "x"), "mode")


@query("SELECT mode, stop_sequence, round(quantile_cont(delay_s, 0.1), 6) AS q10, round(quantile_cont(delay_s, 0.5), 6) AS q50, round(quantile_cont(delay_s, 0.9), 6) AS q90, round(avg(delay_s), 6) AS mean FROM observations GROUP BY ALL", "observations")
def empirical_quantile(spark, d):
    q = lambda p: F.round(F.percentile("delay_s", p), 6)
    return v.observations(spark, d).groupBy("mode", "stop_sequence").agg(q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"), F.round(F.avg("delay_s"), 6).alias("mean"))


_UNIT_SQL = "CAST(('0x' || substr(md5('31|' || route_id), 1, 8)) AS BIGINT) / 4294967296.0"


@query(f"SELECT trip_id, seq, round(ln(50 + 80 * u + 6 * sqrt(least(seq, 64))) + 0.3 * p, 6) AS mu, round(0.4 + 0.25 * u + 0.2 * p, 6) AS sigma FROM (SELECT trip_id, seq, u, greatest(0, 1 - least(abs(h - 7.75), abs(h - 17.25)) / 2.25) AS p FROM (SELECT trip_id, seq, {_UNIT_SQL} AS u, departure // 900 % 96 / 4.0::DOUBLE AS h FROM stop_times JOIN trips USING (trip_id)))", "stop_times", "trips")
def synthetic_params(spark, d):
    s = v.stop_times(spark, d).join(v.trips(spark, d).select("trip_id", "route_id"), "trip_id")
    mu, sigma = dis.synthetic_parameters(dis.stable_unit_column(dis.Synthetic().seed, F.col("route_id")), F.col("departure"), F.col("seq"))
    return s.select("trip_id", "seq", F.round(mu, 6).alias("mu"), F.round(sigma, 6).alias("sigma"))


def _itineraries(spark, d) -> DataFrame:
    """An itinerary for each trip of two stops or more, from its first stop to its last.

    If the next such trip of its block leaves after that and arrives within three hours, that is its second leg. Alternatives
    are the next departures of the route that get there, by time of day as the stop times have no day.
    """
    st, t = v.stop_times(spark, d), v.trips(spark, d).select("trip_id", "route_id", "block_id")
    ends = st.groupBy("trip_id").agg(F.min(F.struct("seq", "stop_id", "departure")).alias("a"), F.max(F.struct("seq", "stop_id", "arrival")).alias("b"))
    rides = ends.filter("a.seq < b.seq").join(t, "trip_id")
    asked = rides.select(F.col("trip_id").alias("leg_id"), "route_id", F.col("a.stop_id").alias("board_stop"), F.col("b.stop_id").alias("alight_stop"), F.col("a.departure").alias("departure"))
    later = net.recoveries(st, t, asked).groupBy(F.col("leg_id").alias("trip_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "departure", "arrival"))).alias("later"))
    own = F.array(F.struct(F.col("a.departure").alias("departure"), F.col("b.arrival").alias("arrival")))
    rest = F.coalesce(F.transform("later", lambda x: F.struct(x["departure"].alias("departure"), x["arrival"].alias("arrival"))), F.array().cast("array<struct<departure: bigint, arrival: bigint>>"))
    rides = rides.join(later, "trip_id", "left").withColumn("ride", F.struct(F.col("route_id").cast("string").alias("route_id"), F.col("a.seq").alias("board_seq"), F.col("b.seq").alias("alight_seq"), F.concat(own, rest).alias("alternatives")))
    w = Window.partitionBy("block_id").orderBy("a.departure", "trip_id")
    rides = rides.withColumns({"next": F.lead("ride").over(w), "end": F.lead("b").over(w)})
    leg = lambda ride, change: F.struct(F.lit(change).cast("int").alias("min_transfer_s"), *(F.col(ride)[c].alias(c) for c in ("route_id", "board_seq", "alight_seq", "alternatives")))
    both = F.coalesce((F.col("next.alternatives")[0]["departure"] >= F.col("b.arrival") + 60) & (F.col("end.arrival") <= F.col("a.departure") + 10800), F.lit(False))
    legs = F.when(both, F.array(leg("ride", 0), leg("next", 60))).otherwise(F.array(leg("ride", 0)))
    last = F.when(both, F.col("end")).otherwise(F.col("b"))
    rows = rides.select(F.col("trip_id").cast("string").alias("itinerary_id"), (F.col("a.departure") - 120).alias("departure"), (last["stop_id"] % 180).cast("long").alias("tail_walk_s"), legs.alias("legs"), last["arrival"].alias("scheduled"))
    # Rows are dear to evaluate, so they are dealt anew; the model's tables are by route.
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "itinerary_id").sortWithinPartitions(F.col("legs")[0]["route_id"], "itinerary_id")


def _route_itineraries(spark, d) -> DataFrame:
    """What scheduled_margins' SQL has: an itinerary of two legs for each route, its times from the counts and sums of all its line items."""
    li = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), "l_quantity", "l_partkey")
    r = li.join(v.trips(spark, d).select("trip_id", "route_id"), "trip_id").groupBy("route_id").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.sum("l_partkey").alias("p"))
    def leg(base, ride, board, alight, change):
        trips = F.array(*(F.struct((base + 600 * k).cast("long").alias("departure"), (base + 600 * k + ride).cast("long").alias("arrival")) for k in range(3)))
        return F.struct(change.cast("int").alias("min_transfer_s"), F.col("route_id").cast("string").alias("route_id"), F.lit(board).alias("board_seq"), F.lit(alight).alias("alight_seq"), trips.alias("alternatives"))

    first = 1_800_000_000 + F.col("route_id") * 900
    ride1, ride2 = 600 + F.col("n") % 600, 600 + F.col("q") % 600
    second = first + ride1 + 120 + F.col("p") % 480
    return r.select(F.col("route_id").cast("string").alias("itinerary_id"), (first - 120).cast("long").alias("departure"), (F.col("n") % 180).cast("long").alias("tail_walk_s"), F.array(leg(first, ride1, 2, 9, F.lit(0)), leg(second, ride2, 4, 12, F.lit(60))).alias("legs"), (second + ride2).cast("long").alias("scheduled"))


def _with_deadlines(spark, d) -> DataFrame:
    return _itineraries(spark, d).withColumn("deadline", F.array(*(F.col("scheduled") + F.col("tail_walk_s") + x for x in (0, 300, 600, 900, 1200, 1800))))


_ITINERARY_SQL = """, r AS (SELECT route_id, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, sum(l_partkey)::BIGINT AS p FROM lineitem JOIN trips ON trip_id = l_orderkey GROUP BY route_id)"""


@query(_ITINERARY_SQL + " SELECT CAST(route_id AS VARCHAR) AS itinerary_id, CAST(60 + p % 480 AS BIGINT) AS margin FROM r", "trips")
def scheduled_margins(spark, d):
    return _route_itineraries(spark, d).select("itinerary_id", F.explode(rel.scheduled_margins(F.col("legs"))).alias("margin"))


@query()
def lognormal_cdf(spark, d):
    """The synthetic model's probabilities at a few delays for each stop time's parameters."""
    params = synthetic_params(spark, d)

    def run(batches):
        for pdf in batches:
            for x in (0, 60, 300, 900):
                pdf[f"cdf_{x}"] = dis.lognormal_cdf(float(x), pdf["mu"].to_numpy(), pdf["sigma"].to_numpy(), dis.SHIFT).round(6)
            yield pdf

    return params.mapInPandas(run, "trip_id long, seq int, mu double, sigma double, cdf_0 double, cdf_60 double, cdf_300 double, cdf_900 double")


@query()
def arrival_probability_convolution(spark, d):
    return rel.arrival_probability(_with_deadlines(spark, d), dis.Synthetic(), invented=True)


@query()
def arrival_probability_montecarlo(spark, d):
    return rel.arrival_probability(_with_deadlines(spark, d), dis.Synthetic(), "simulation", samples=5000, invented=True)


@query()
def probability_method_errors(spark, d):
    """Coarser grids and smaller samples against the finest grid."""
    rows = checkpointed(_with_deadlines(spark, d))  # each run reads them
    truth = rel.arrival_probability(rows, dis.Synthetic(), step=5, invented=True)
    runs = [rel.arrival_probability(rows, dis.Synthetic(), step=s, invented=True).withColumn("method", F.lit(f"grid {s:03d}")) for s in (10, 30, 60)]
    runs += [rel.arrival_probability(rows, dis.Synthetic(), "simulation", samples=n, invented=True).withColumn("method", F.lit(f"samples {n:05d}")) for n in (100, 1000)]
    out = runs[0]
    for r in runs[1:]:
        out = out.union(r)
    return rel.method_errors(out, truth)


@query()
def robust_choice(spark, d):
    """Of each block's itineraries, the one most likely to arrive in its time and ten minutes."""
    rows = _itineraries(spark, d).withColumn("deadline", F.col("scheduled") + F.col("tail_walk_s") + 600)
    p = rel.arrival_probability(rows, dis.Synthetic(), invented=True).withColumn("trip_id", F.col("itinerary_id").cast("long")).join(v.trips(spark, d).select("trip_id", "block_id"), "trip_id")
    c = p.select(F.col("block_id").alias("query_id"), F.col("trip_id").alias("pos"), F.round("probability", 6).alias("probability"))
    return rel.robust(c)


# Choices among candidates

_CANDIDATES = "SELECT o_custkey AS query_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS pos, CAST(floor(o_totalprice / 100) AS BIGINT) AS arrival, o_orderkey % 4 AS transfers, o_orderkey % 97 / 97.0 AS probability, [o_orderkey * 7 % 900, o_orderkey * 13 % 1200] AS margins FROM orders"


def _candidates(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return v.table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("arrival"), (k % 4).alias("transfers"), (k % 97 / 97.0).alias("probability"), F.array(k * 7 % 900, k * 13 % 1200).alias("margins"))


def _choice(order: str) -> str:
    return f"SELECT query_id, pos, arrival, transfers FROM ({_CANDIDATES}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}) = 1"


@query(_choice("arrival, transfers, pos"))
def strategy_fastest(spark, d):
    return rel.fastest(_candidates(spark, d)).select("query_id", "pos", "arrival", "transfers")


@query(_choice("transfers, arrival, pos"))
def strategy_fewest(spark, d):
    return rel.fewest_transfers(_candidates(spark, d)).select("query_id", "pos", "arrival", "transfers")


@query(_choice("CASE WHEN list_min(margins) >= 300 THEN 0 ELSE 1 END, CASE WHEN list_min(margins) >= 300 THEN 0 ELSE -list_min(margins) END, arrival, CASE WHEN list_min(margins) >= 300 THEN transfers END NULLS FIRST, pos"))
def strategy_fixed_margin(spark, d):
    return rel.fixed_margin(_candidates(spark, d)).select("query_id", "pos", "arrival", "transfers")


@query(f"SELECT query_id, CASE WHEN count(*) >= 2 THEN round(max(probability) - min(probability), 6) END AS spread FROM ({_CANDIDATES}) GROUP BY query_id")
def candidate_spread(spark, d):
    return rel.divergence(_candidates(spark, d))


# Trips of several legs

_INSTANCES = """WITH candidates AS (SELECT o_custkey AS instance_id, o_orderkey % 3 AS leg, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) - 1 AS pos, o_orderkey % 3 * 9000 + o_orderkey * 37 % 9000 AS ready, o_orderkey % 3 * 9000 + o_orderkey * 37 % 9000 + 1800 + o_orderkey % 1200 AS arrival, o_orderkey % 7 % 3 AS transfers, o_orderkey % 600 AS walk_s FROM orders),
legs AS (SELECT DISTINCT o_custkey AS instance_id, leg, 600 AS dwell_s, CASE WHEN leg = 1 THEN 9500 END AS window_from, CASE WHEN leg = 1 THEN 21000 END AS window_to FROM orders, (SELECT unnest([0, 1, 2]) AS leg)),
instances AS (SELECT DISTINCT o_custkey AS instance_id, 3 AS legs, 3 AS max_transfers, 1000 AS max_walk_s, 27500 + 500 * (o_custkey % 4) AS deadline FROM orders)"""


def _instances(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    o = v.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    ready = k % 3 * 9000 + k * 37 % 9000
    c = o.select(F.col("o_custkey").alias("instance_id"), (k % 3).cast("int").alias("leg"), (F.row_number().over(Window.partitionBy("o_custkey", k % 3).orderBy("o_orderkey")) - 1).alias("pos"), ready.alias("ready"), (ready + 1800 + k % 1200).alias("arrival"), (k % 7 % 3).alias("transfers"), (k % 600).alias("walk_s"))
    ids = o.select(F.col("o_custkey").alias("instance_id")).distinct()
    one = F.col("leg") == 1
    legs = ids.withColumn("leg", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumns({"dwell_s": F.lit(600), "window_from": F.when(one, 9500), "window_to": F.when(one, 21000)})
    return ids.withColumns({"legs": F.lit(3), "max_transfers": F.lit(3), "max_walk_s": F.lit(1000), "deadline": 27500 + 500 * (F.col("instance_id") % 4)}), legs, c


@query(_INSTANCES + " SELECT instance_id, CAST(sum(t) AS BIGINT) AS min_transfers, CAST(sum(w) AS BIGINT) AS min_walk_s FROM (SELECT instance_id, min(transfers) AS t, min(walk_s) AS w FROM candidates GROUP BY instance_id, leg) GROUP BY instance_id")
def csp_lower_bounds(spark, d):
    return mul.lower_bounds(_instances(spark, d)[2])


@query(_INSTANCES + """, a AS (SELECT c.*, window_from, window_to, lag(arrival + dwell_s) OVER (PARTITION BY instance_id ORDER BY leg) AS free FROM candidates c JOIN legs USING (instance_id, leg) WHERE pos = 0),
s AS (SELECT instance_id, coalesce(bool_or(arrival < window_from), FALSE) AS e, coalesce(bool_or(arrival > window_to), FALSE) AS l, coalesce(bool_or(ready < free), FALSE) AS p, sum(transfers) AS t, sum(walk_s) AS w, max(arrival) AS m FROM a GROUP BY instance_id)
SELECT instance_id, concat_ws(',', CASE WHEN m > deadline THEN 'deadline' END, CASE WHEN p THEN 'precedence' END, CASE WHEN t > max_transfers THEN 'transfers' END, CASE WHEN w > max_walk_s THEN 'walk' END, CASE WHEN e THEN 'window_early' END, CASE WHEN l THEN 'window_late' END) AS violations FROM s JOIN instances USING (instance_id)""")
def csp_violations(spark, d):
    i, legs, c = _instances(spark, d)
    return mul.violations(c.filter("pos = 0"), legs, i).withColumn("violations", F.concat_ws(",", "violations"))


_FIT = "{c}.arrival >= coalesce({l}.window_from, {c}.arrival) AND {c}.arrival <= coalesce({l}.window_to, {c}.arrival) AND {c}.arrival <= deadline"
_COMPLETE = """, every AS (SELECT instance_id, x.pos || ',' || y.pos || ',' || z.pos AS positions, [x.pos, y.pos, z.pos] AS ps, z.arrival FROM instances
JOIN candidates x USING (instance_id) JOIN candidates y USING (instance_id) JOIN candidates z USING (instance_id)
WHERE x.leg = 0 AND y.leg = 1 AND z.leg = 2 AND y.ready >= x.arrival + 600 AND z.ready >= y.arrival + 600 AND y.arrival BETWEEN 9500 AND 21000 AND greatest(x.arrival, y.arrival, z.arrival) <= deadline AND x.transfers + y.transfers + z.transfers <= max_transfers AND x.walk_s + y.walk_s + z.walk_s <= max_walk_s),
complete AS (SELECT instance_id, positions, arrival FROM every QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY arrival, ps) = 1)"""
_GREEDY = """, g0 AS (SELECT i.*, c.pos::VARCHAR AS positions, c.arrival, c.transfers AS t, c.walk_s AS w FROM instances i JOIN candidates c USING (instance_id) WHERE leg = 0 AND c.arrival <= deadline AND c.transfers <= max_transfers AND c.walk_s <= max_walk_s QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY c.arrival, c.transfers, c.walk_s, c.pos) = 1),
g1 AS (SELECT g.* REPLACE (positions || ',' || c.pos AS positions, c.arrival AS arrival, t + c.transfers AS t, w + c.walk_s AS w) FROM g0 g JOIN candidates c USING (instance_id) WHERE leg = 1 AND c.ready >= g.arrival + 600 AND c.arrival BETWEEN 9500 AND 21000 AND c.arrival <= deadline AND t + c.transfers <= max_transfers AND w + c.walk_s <= max_walk_s QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY c.arrival, c.transfers, c.walk_s, c.pos) = 1),
greedy AS (SELECT instance_id, positions || ',' || c.pos AS positions, c.arrival FROM g1 g JOIN candidates c USING (instance_id) WHERE leg = 2 AND c.ready >= g.arrival + 600 AND c.arrival <= deadline AND t + c.transfers <= max_transfers AND w + c.walk_s <= max_walk_s QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY c.arrival, c.transfers, c.walk_s, c.pos) = 1)"""


def _named(df: DataFrame) -> DataFrame:
    return df.select("instance_id", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"), "arrival")


@query(_INSTANCES + _COMPLETE + " SELECT * FROM complete")
def csp_complete(spark, d):
    return _named(mul.complete(*_instances(spark, d)))


@query(_INSTANCES + _GREEDY + " SELECT * FROM greedy")
def csp_greedy(spark, d):
    return _named(mul.greedy(*_instances(spark, d)))


@query(_INSTANCES + _COMPLETE + _GREEDY + " SELECT outcome, count(*) AS n, CAST(count(*) FILTER (WHERE same) AS BIGINT) AS same_arrival FROM (SELECT CASE WHEN c.arrival IS NULL THEN 'unsolvable' WHEN g.arrival IS NULL THEN 'greedy_fails' ELSE 'both' END AS outcome, coalesce(g.arrival = c.arrival, FALSE) AS same FROM instances LEFT JOIN greedy g USING (instance_id) LEFT JOIN complete c USING (instance_id)) GROUP BY outcome")
def csp_agreement(spark, d):
    i, legs, c = _instances(spark, d)
    rows = mul.agreement(i, mul.greedy(i, legs, c), mul.complete(i, legs, c))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.count(F.when(F.col("same_arrival"), 1)).alias("same_arrival"))


@query(_INSTANCES + _COMPLETE + _GREEDY + """ SELECT city, legs, slack, count(*) AS n, count(c.arrival) AS solvable, count(g.arrival) AS greedy_solves, CAST(count(*) FILTER (WHERE g.arrival = c.arrival) AS BIGINT) AS same_arrival, round(count(g.arrival) / nullif(count(c.arrival), 0), 6) AS greedy_share, round(avg(g.arrival - c.arrival), 6) AS later_s
FROM (SELECT instance_id, instance_id % 3 AS city, legs, 500 * (instance_id % 4) AS slack FROM instances) LEFT JOIN greedy g USING (instance_id) LEFT JOIN complete c USING (instance_id) GROUP BY ROLLUP (city, legs, slack)""")
def csp_outcome_table(spark, d):
    """Greedy against complete choices by city, legs and slack, with lines for what they add up to."""
    i, legs, c = _instances(spark, d)
    rows = mul.agreement(i, mul.greedy(i, legs, c), mul.complete(i, legs, c)).join(i.select("instance_id", (F.col("instance_id") % 3).alias("city"), "legs", (500 * (F.col("instance_id") % 4)).alias("slack")), "instance_id")
    return mul.outcome_table(rows, "city", "legs", "slack")


# Streams over what is in the events table, with the batch operators' SQL


def _streamed(spark, d, build) -> DataFrame:
    """The result of a stream over the events, run over all that is there. build: of the stream's events to the stream's result."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")  # a stream reads a pattern, not a single file
    stream = build(events)
    rt.run_available(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("SELECT trip_id, event_type, feed_ts, coarse FROM (SELECT *, lag(coarse) OVER w AS p, row_number() OVER w AS r FROM observations WINDOW w AS (PARTITION BY trip_id, event_type ORDER BY feed_ts, coarse)) WHERE r = 1 OR p IS DISTINCT FROM coarse", "observations")
def stream_change_dedup(spark, d):
    def build(e):
        rows = e.select(F.col("user_id").alias("trip_id"), "event_type", v.epoch(F.col("ts")).alias("feed_ts"), F.floor(F.col("value") / 50).cast("long").alias("coarse"))
        return rt.change_dedup(rows, ("trip_id", "event_type"), "feed_ts", "coarse")

    return _streamed(spark, d, build)


@query("SELECT city, p AS gap_start, instant AS gap_end, instant - p AS gap_s FROM (SELECT city, instant, lag(instant) OVER (PARTITION BY city ORDER BY instant) AS p FROM polls WHERE outcome IN ('saved', 'duplicate')) WHERE instant - p >= 3600", "polls")
def stream_gaps(spark, d):
    def build(e):
        ok = e.filter(F.col("event_type").isin("click", "view", "purchase"))
        return rt.gaps(ok.select((F.col("user_id") % 3).alias("city"), v.epoch(F.col("ts")).alias("instant")), "city", "instant", 3600)

    return _streamed(spark, d, build)


# Experiment tables


@query("SELECT mode, stop_sequence, count(*) AS n, round(avg(delay_s), 6) AS delay_s_mean, round(coalesce(stddev_samp(delay_s), 0), 6) AS delay_s_std, round(avg(coarse), 6) AS coarse_mean, round(coalesce(stddev_samp(coarse), 0), 6) AS coarse_std FROM observations GROUP BY ALL", "observations")
def experiment_summary(spark, d):
    return dia.city_table(v.observations(spark, d), "mode", "stop_sequence", measures=("delay_s", "coarse"))


@query()
def variant_savings(spark, d):
    """By variant of the search, the part of the plain search's states that it holds: with fewer boardings, and pruned by what is known at the destination."""
    asked = _search(spark, d)
    base = checkpointed(sea.states_seen(*asked, START, END, prune=False)).withColumnRenamed("states", "base")
    out = None
    for name, how in {"pruned": {}, "two boardings": {"boardings": 2, "prune": False}, "one boarding": {"boardings": 1, "prune": False}}.items():
        one = sea.states_seen(*asked, START, END, **how).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionAll(one)
    both = out.join(base, "query_id").select("variant", (F.col("states") / F.col("base")).alias("ratio"))
    return dia.city_table(both, "variant", measures=("ratio",))
