"""Timetable-shaped views of the given tables, and the same views as SQL for DuckDB.

stops come from suppliers, trips from orders, stop times from line items, observations and polls from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.functions.modes import route_type_label
from headway.functions.times import epoch

TZ = "Europe/Rome"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stops of a district; each district is a square of its own with its own stations, so the plane grows with the table.
DISTRICT = 1000


def stops(spark: SparkSession, d: str, districts: bool = True) -> DataFrame:
    """Without districts, all stops lie in one square with 25 stations (ONE_SQUARE), so pairs grow with the table's square."""
    k = F.col("s_suppkey")
    district = F.expr(f"s_suppkey div {DISTRICT}") if districts else F.lit(0)
    return table(spark, d, "supplier").select(k.alias("stop_id"), (k * 7919 % 3000 - 1500 + 3000 * district).alias("x_m"), (k * 104729 % 3000 - 1500).alias("y_m"), (F.col("s_nationkey") + 25 * district).alias("parent_station"), (k % 3).cast("int").alias("wheelchair"))


def stations(spark: SparkSession, d: str) -> DataFrame:
    return stops(spark, d).select(F.col("parent_station").alias("stop_id")).distinct().withColumn("wheelchair", (F.col("stop_id") % 3).cast("int"))


def trips(spark: SparkSession, d: str, route: str = "o_custkey div 5") -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), F.expr(route).alias("route_id"), F.col("o_orderpriority").alias("service_id"), F.to_date("o_orderdate").alias("service_date"), F.col("o_custkey").alias("block_id"))


def stop_times(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    run = F.sum(60 + F.col("l_partkey") % 300).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.row_number().over(w).alias("seq"), F.col("l_suppkey").alias("stop_id"), (21600 + F.col("l_orderkey") * 37 % 64800 + run).cast("long").alias("arrival"), "l_linenumber")
    return rows.select("trip_id", "seq", "stop_id", "arrival", (F.col("arrival") + F.col("l_linenumber") * 5).cast("long").alias("departure"))


def routes(spark: SparkSession, d: str) -> DataFrame:
    """The trips' routes; their types are 0 to 13, of which some codes mean nothing."""
    return trips(spark, d).select("route_id").distinct().withColumn("route_type", (F.col("route_id") % 14).cast("int"))


def mode_of(number: Column) -> Column:
    return route_type_label(number % 4)


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seq = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    e = e.select("event_id", F.to_date("ts").alias("service_date"), F.col("user_id").alias("trip_id"), seq.alias("stop_sequence"), epoch(F.col("ts")).alias("feed_ts"), "value", "event_type", (F.floor(F.col("value") * 10).cast("int") - 600).alias("delay_s"))
    return e.withColumn("observed", F.col("feed_ts") + F.floor(F.col("value") / 60).cast("long") * 60).withColumn("mode", mode_of(F.col("trip_id"))).withColumn("coarse", F.floor(F.col("value") / 50).cast("long"))


def polls(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    outcome = F.when(F.col("event_type").isin("click", "view"), "saved").when(F.col("event_type") == "purchase", "duplicate").when(F.col("event_type") == "signup", "rejected").otherwise("failed")
    return o.select((F.col("trip_id") % 3).alias("city"), F.col("feed_ts").alias("instant"), "event_id", outcome.alias("outcome"), F.floor(F.col("value") / 100).cast("long").alias("feed_ts"))


def serves(spark: SparkSession, d: str) -> DataFrame:
    """The stops that trips of a route call at."""
    return stop_times(spark, d).select("trip_id", "stop_id").join(trips(spark, d).select("trip_id", "route_id"), "trip_id").select("route_id", "stop_id").distinct()


def declared(spark: SparkSession, d: str) -> DataFrame:
    """Declared transfers, from each supplier of a part to its next one; the part's key gives the time."""
    p = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("from_stop_id")).distinct()
    p = p.withColumn("to_stop_id", F.lead("from_stop_id").over(Window.partitionBy("l_partkey").orderBy("from_stop_id"))).filter("to_stop_id IS NOT NULL")
    return p.select("from_stop_id", "to_stop_id", (240 + F.col("l_partkey") % 600).alias("min_transfer_time"))


SQL = {
    "stops": f"SELECT s_suppkey AS stop_id, s_suppkey * 7919 % 3000 - 1500 + 3000 * (s_suppkey // {DISTRICT}) AS x_m, s_suppkey * 104729 % 3000 - 1500 AS y_m, s_nationkey + 25 * (s_suppkey // {DISTRICT}) AS parent_station, CAST(s_suppkey % 3 AS INT) AS wheelchair FROM supplier",
    "stations": "SELECT DISTINCT parent_station AS stop_id, CAST(parent_station % 3 AS INT) AS wheelchair FROM stops",
    "trips": "SELECT o_orderkey AS trip_id, o_custkey // 5 AS route_id, o_orderpriority AS service_id, CAST(o_orderdate AS DATE) AS service_date, o_custkey AS block_id FROM orders",
    "stop_times": """SELECT trip_id, seq, stop_id, arrival, CAST(arrival + l_linenumber * 5 AS BIGINT) AS departure FROM (
        SELECT l_orderkey AS trip_id, CAST(row_number() OVER w AS INT) AS seq, l_suppkey AS stop_id, l_linenumber, CAST(21600 + l_orderkey * 37 % 64800 + sum(60 + l_partkey % 300) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS arrival
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey))""",
    "routes": "SELECT DISTINCT route_id, CAST(route_id % 14 AS INT) AS route_type FROM trips",
    "observations": """SELECT *, feed_ts + CAST(floor(value / 60) AS BIGINT) * 60 AS observed, ['tram', 'metro', 'rail', 'bus'][CAST(trip_id % 4 AS INT) + 1] AS mode, CAST(floor(value / 50) AS BIGINT) AS coarse FROM (
        SELECT event_id, CAST(ts AS DATE) AS service_date, user_id AS trip_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS INT) AS stop_sequence, CAST(floor(epoch(ts)) AS BIGINT) AS feed_ts, value, event_type, CAST(floor(value * 10) AS INT) - 600 AS delay_s FROM events)""",
    "polls": "SELECT trip_id % 3 AS city, feed_ts AS instant, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'saved' WHEN event_type = 'purchase' THEN 'duplicate' WHEN event_type = 'signup' THEN 'rejected' ELSE 'failed' END AS outcome, CAST(floor(value / 100) AS BIGINT) AS feed_ts FROM observations",
    "serves": "SELECT DISTINCT route_id, stop_id FROM stop_times JOIN trips USING (trip_id)",
    "declared": "SELECT a AS from_stop_id, b AS to_stop_id, 240 + l_partkey % 600 AS min_transfer_time FROM (SELECT l_partkey, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS b FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) WHERE b IS NOT NULL",
    "calendar": """SELECT * FROM (VALUES ('1-URGENT', 1, 1, 1, 1, 1, 0, 0, DATE '1992-01-01', DATE '1998-12-31'), ('2-HIGH', 1, 1, 1, 1, 1, 1, 1, DATE '1992-01-01', DATE '1998-12-31'), ('3-MEDIUM', 0, 0, 0, 0, 0, 1, 1, DATE '1992-01-01', DATE '1998-12-31'), ('4-NOT SPECIFIED', 1, 0, 1, 0, 1, 0, 0, DATE '1994-06-01', DATE '1996-05-31'))
        AS t(service_id, monday, tuesday, wednesday, thursday, friday, saturday, sunday, start_date, end_date)""",
    "calendar_dates": """SELECT * FROM (VALUES ('5-LOW', DATE '1995-06-02', 1), ('1-URGENT', DATE '1995-06-02', 2), ('2-HIGH', DATE '1995-08-15', 1), ('2-HIGH', DATE '1995-08-15', 2), ('3-MEDIUM', DATE '1995-06-02', 1)) AS t(service_id, date, exception_type)""",
    "walks": """SELECT a.stop_id AS from_stop_id, b.stop_id AS to_stop_id, CAST(CASE WHEN d2 <= 2500 THEN 60 WHEN d2 <= 10000 THEN 120 WHEN d2 <= 40000 THEN 180 ELSE 240 END AS INT) AS walk_s FROM stops a, stops b, LATERAL (SELECT (a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m) AS d2) WHERE a.stop_id <> b.stop_id AND d2 <= 62500""",
    "same_station": "SELECT a.stop_id AS from_stop_id, b.stop_id AS to_stop_id FROM stops a JOIN stops b USING (parent_station) WHERE a.stop_id <> b.stop_id",
    "transfers": """SELECT from_stop_id, to_stop_id, CAST(min(t) FILTER (WHERE level = best) AS INT) AS min_transfer_time, any_value(walk_s) AS walk_s, ['declared', 'station', 'walk'][best] AS source FROM (
        SELECT *, min(level) OVER (PARTITION BY from_stop_id, to_stop_id) AS best FROM (
        SELECT from_stop_id, to_stop_id, 1 AS level, max(min_transfer_time) AS t FROM declared GROUP BY ALL UNION ALL SELECT from_stop_id, to_stop_id, 2, 180 FROM same_station UNION ALL SELECT from_stop_id, to_stop_id, 3, walk_s + 60 FROM walks))
        LEFT JOIN walks USING (from_stop_id, to_stop_id) GROUP BY from_stop_id, to_stop_id, best""",
    "accessible_stops": "SELECT s.stop_id FROM stops s LEFT JOIN stations p ON p.stop_id = s.parent_station WHERE s.wheelchair = 1 OR (s.wheelchair = 0 AND p.wheelchair = 1)",
    "lifts_out": "SELECT s_suppkey AS stop_id FROM supplier WHERE s_acctbal < 3000",
    "accessible": "SELECT from_stop_id, to_stop_id FROM transfers WHERE coalesce(walk_s <= 180, TRUE) AND from_stop_id IN (FROM accessible_stops) AND to_stop_id IN (FROM accessible_stops) AND from_stop_id NOT IN (FROM lifts_out) AND to_stop_id NOT IN (FROM lifts_out)",
    "network": """SELECT trip_id, seq, stop_id, arrival, departure, lead(seq) OVER (PARTITION BY trip_id ORDER BY seq) AS next_seq FROM stop_times WHERE departure >= 28800 - 3600 AND arrival <= 36000 + 3600""",
}
#: `stops` without districts, for statements that take it in the place of `stops`.
ONE_SQUARE = "SELECT s_suppkey AS stop_id, s_suppkey * 7919 % 3000 - 1500 AS x_m, s_suppkey * 104729 % 3000 - 1500 AS y_m, s_nationkey AS parent_station, CAST(s_suppkey % 3 AS INT) AS wheelchair FROM supplier"
#: `trips` with all trips on 40 routes, likewise.
FORTY_ROUTES = "SELECT o_orderkey AS trip_id, o_custkey % 40 AS route_id, o_orderpriority AS service_id, CAST(o_orderdate AS DATE) AS service_date, o_custkey AS block_id FROM orders"
#: What each view reads of the others.
NEEDS = {"stations": ["stops"], "routes": ["trips"], "polls": ["observations"], "serves": ["stop_times", "trips"], "walks": ["stops"], "same_station": ["stops"], "transfers": ["declared", "same_station", "walks"], "accessible_stops": ["stops", "stations"], "accessible": ["transfers", "accessible_stops", "lifts_out"], "network": ["stop_times"]}


def with_views(sql: str, *names: str, recursive: bool = False, **own: str) -> str:
    """The statement behind the views it names and those they need; a statement that begins with `,` adds views of its own, and `own` holds those it takes in the place of the common ones."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in NEEDS.get(n, []):
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({(SQL | own)[n]})" for n in order) + "\n" + sql.strip()


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SQL["calendar"])


def calendar_dates(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SQL["calendar_dates"])


def lifts_out(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").filter("s_acctbal < 3000").select(F.col("s_suppkey").alias("stop_id"))
