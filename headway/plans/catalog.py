"""The registered queries: each a function of (spark, folder) over the views, with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions import geo, modes, times
from headway.operators import consolidation as con
from headway.operators import diagnostics as dia
from headway.operators import network as net
from headway.operators import services as ser
from headway.operators import transfers as tra
from headway.operators.quantiles import exact_quantiles
from headway.operators.state import checkpointed
from headway.plans import views as v
from headway.plans.views import TZ, with_views
from headway.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = dt.date(1995, 6, 2)
ORDER = ("feed_ts", "event_id")
START, END = 28800, 36000


def query(sql: str | None = None, *names: str, recursive: bool = False, **own: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *names, recursive=recursive, **own) if names else sql.strip()
        return f

    return add


_STATS = "count({0}) AS n, round(quantile_cont({0}, 0.5), 6) AS median, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std"
_SUMMARY = _STATS + ", CAST(min({0}) AS DOUBLE) AS low, round(quantile_cont({0}, 0.25), 6) AS q1, round(quantile_cont({0}, 0.75), 6) AS q3, CAST(max({0}) AS DOUBLE) AS high"


# Observations by hour, mode and lead time


@query(f"SELECT CAST(hour(to_timestamp(observed) AT TIME ZONE '{TZ}') AS INT) AS hour, mode, {_STATS.format('delay_s')} FROM observations GROUP BY ALL", "observations")
def delay_by_hour_mode(spark, d):
    o = v.observations(spark, d).withColumn("hour", times.local_hour(F.col("observed"), TZ))
    return dia.delay_by(o, "hour", "mode")


@query(f"SELECT {_SUMMARY.format('delay_s')} FROM observations", "observations")
def delay_summary(spark, d):
    return dia.delay_summary(v.observations(spark, d))


@query(f"SELECT mode, {_SUMMARY.format('(observed - feed_ts) / 60.0')} FROM observations GROUP BY mode", "observations")
def lead_summary_by_mode(spark, d):
    o = v.observations(spark, d).withColumn("lead_min", (F.col("observed") - F.col("feed_ts")) / 60.0)
    return dia.delay_summary(o, "mode", value="lead_min")


@query(f"SELECT hour, CAST(lead_band AS INT) AS lead_band, {_STATS.format('delay_s')} FROM (SELECT *, CAST(hour(to_timestamp(feed_ts) AT TIME ZONE '{TZ}') AS INT) AS hour, CASE WHEN observed - feed_ts <= 0 THEN 0 WHEN observed - feed_ts <= 300 THEN 1 WHEN observed - feed_ts <= 900 THEN 2 WHEN observed - feed_ts <= 1800 THEN 3 WHEN observed - feed_ts <= 3600 THEN 4 WHEN observed - feed_ts <= 7200 THEN 5 ELSE 6 END AS lead_band FROM observations) GROUP BY ALL", "observations")
def hour_by_lead_bucket(spark, d):
    o = v.observations(spark, d).withColumns({"hour": times.local_hour(F.col("feed_ts"), TZ), "lead_band": times.lead_band(F.col("observed") - F.col("feed_ts"))})
    return dia.delay_by(o, "hour", "lead_band")


@query("SELECT round(quantile_cont(observed - feed_ts, 0.25), 6) AS q1, round(quantile_cont(observed - feed_ts, 0.5), 6) AS median, round(quantile_cont(observed - feed_ts, 0.75), 6) AS q3, CAST(count(*) FILTER (WHERE observed - feed_ts > 360) AS BIGINT) AS far_ahead FROM observations", "observations")
def lead_quartiles(spark, d):
    o = v.observations(spark, d).withColumn("lead_s", F.col("observed") - F.col("feed_ts"))
    s = dia.delay_summary(o, value="lead_s").select("q1", "median", "q3")
    return s.join(F.broadcast(o.agg(F.count(F.when(F.col("lead_s") > 360, 1)).alias("far_ahead"))))  # one row each


@query(f"SELECT CAST(hour(to_timestamp(feed_ts) AT TIME ZONE '{TZ}') AS INT) AS hour, count(*) AS n FROM observations GROUP BY ALL", "observations")
def emission_hours(spark, d):
    return v.observations(spark, d).groupBy(times.local_hour(F.col("feed_ts"), TZ).alias("hour")).agg(F.count("*").alias("n"))


# Scalars of time and calendar


@query("SELECT trip_id, seq, CAST(departure AS INT) AS seconds FROM stop_times", "stop_times")
def gtfs_time_parse(spark, d):
    s = v.stop_times(spark, d)
    t = F.col("departure")
    text = F.concat_ws(":", F.floor(t / 3600).cast("string"), F.lpad(F.floor(t / 60 % 60).cast("string"), 2, "0"), F.lpad((t % 60).cast("string"), 2, "0"))
    return s.select("trip_id", "seq", times.parse_time(text).alias("seconds"))


@query(f"SELECT trip_id, seq, CAST(epoch((service_date + INTERVAL 12 HOUR) AT TIME ZONE '{TZ}') AS BIGINT) - 43200 + departure AS instant FROM stop_times JOIN trips USING (trip_id)", "stop_times", "trips")
def service_instant_dst(spark, d):
    rows = v.stop_times(spark, d).join(v.trips(spark, d).select("trip_id", "service_date"), "trip_id")
    return rows.select("trip_id", "seq", times.service_instant(F.col("service_date"), F.col("departure"), TZ).alias("instant"))


@query("SELECT CAST(service_date + CAST(floor(departure / 86400.0) AS INT) AS VARCHAR) AS day, count(*) AS n, CAST(count(*) FILTER (WHERE departure >= 86400) AS BIGINT) AS past_midnight FROM stop_times JOIN trips USING (trip_id) GROUP BY ALL", "stop_times", "trips")
def past_midnight_day(spark, d):
    rows = v.stop_times(spark, d).join(v.trips(spark, d).select("trip_id", "service_date"), "trip_id")
    return rows.groupBy(times.calendar_day(F.col("service_date"), F.col("departure")).cast("string").alias("day")).agg(F.count("*").alias("n"), F.count(F.when(times.past_midnight(F.col("departure")), 1)).alias("past_midnight"))


_ACTIVE = """(SELECT DISTINCT day, service_id FROM (SELECT day, service_id FROM days JOIN calendar ON day BETWEEN start_date AND end_date WHERE [monday, tuesday, wednesday, thursday, friday, saturday, sunday][isodow(day)] = 1 UNION ALL SELECT date, service_id FROM calendar_dates WHERE exception_type = 1 AND date IN (SELECT day FROM days))
    EXCEPT SELECT date, service_id FROM calendar_dates WHERE exception_type = 2)"""
_DAYS = ", days AS (SELECT DISTINCT service_date AS day FROM trips), active AS " + _ACTIVE


@query(f"{_DAYS} SELECT CAST(a.day AS VARCHAR) AS day, service_id, count(trip_id) AS trips FROM active a LEFT JOIN trips t ON t.service_id = a.service_id AND t.service_date = a.day GROUP BY a.day, a.service_id".replace("service_id, count", "a.service_id AS service_id, count"), "trips", "calendar", "calendar_dates")
def active_services(spark, d):
    t = v.trips(spark, d)
    active = ser.services_by_day(v.calendar(spark, d), v.calendar_dates(spark, d), t.select(F.col("service_date").alias("day")).distinct())
    n = t.groupBy(F.col("service_date").alias("day"), "service_id").agg(F.count("*").alias("trips"))
    return active.join(n, ["day", "service_id"], "left").select(F.col("day").cast("string").alias("day"), "service_id", F.coalesce("trips", F.lit(0)).cast("long").alias("trips"))


_ON_DAY = f", days AS (SELECT DATE '{DAY}' AS day), active AS {_ACTIVE}"


@query(f"{_ON_DAY} SELECT trip_id, route_id, service_id FROM trips WHERE service_id IN (SELECT service_id FROM active)", "trips", "calendar", "calendar_dates")
def active_trips(spark, d):
    s = ser.active_services(v.calendar(spark, d), v.calendar_dates(spark, d), DAY)
    return ser.active_trips(v.trips(spark, d), s).select("trip_id", "route_id", "service_id")


@query(f"{_ON_DAY} SELECT (SELECT count(DISTINCT service_id) FROM trips WHERE service_id IN (SELECT service_id FROM active)) AS services, count(*) AS trips, CAST(count(*) FILTER (WHERE service_id IN (SELECT service_id FROM active)) AS BIGINT) AS active_trips, count(DISTINCT trip_id) FILTER (WHERE service_id IN (SELECT service_id FROM active)) AS distinct_active_trips FROM trips", "trips", "calendar", "calendar_dates")
def calendar_control(spark, d):
    s = ser.active_services(v.calendar(spark, d), v.calendar_dates(spark, d), DAY)
    return ser.calendar_control(v.trips(spark, d), s)


_VERSIONS = ", versions AS (SELECT block_id % 5 AS city, date_trunc('month', service_date)::DATE AS valid_from, CAST(max(trip_id) AS VARCHAR) AS version FROM trips GROUP BY ALL)"


def _versions(t: DataFrame) -> DataFrame:
    return t.groupBy((F.col("block_id") % 5).alias("city"), F.trunc("service_date", "month").alias("valid_from")).agg(F.max("trip_id").cast("string").alias("version"))


@query(f"{_VERSIONS} SELECT t.trip_id, CAST(t.service_date AS VARCHAR) AS service_date, CAST(v.valid_from AS VARCHAR) AS valid_from, v.version FROM (SELECT *, block_id % 5 AS city FROM trips) t ASOF LEFT JOIN versions v ON t.city = v.city AND t.service_date >= v.valid_from", "trips")
def schedule_version_asof(spark, d):
    t = v.trips(spark, d)
    return ser.version_as_of(t.withColumn("city", F.col("block_id") % 5), _versions(t), keys=("city",)).select("trip_id", *(F.col(c).cast("string").alias(c) for c in ("service_date", "valid_from")), "version")


@query(", starts AS (SELECT DISTINCT CAST(21600 + 7200 * (trip_id % 5) AS BIGINT) AS start FROM trips) SELECT trip_id, seq, coalesce((SELECT max(start) FROM starts WHERE start <= departure), (SELECT min(start) FROM starts)) AS start FROM stop_times", "stop_times", "trips")
def graph_for_instant(spark, d):
    starts = v.trips(spark, d).select((21600 + 7200 * (F.col("trip_id") % 5)).cast("long").alias("start")).distinct()
    return ser.version_or_first(v.stop_times(spark, d), starts, "departure").select("trip_id", "seq", "start")


# Consolidation

_SCHEDULE = ", schedule AS (SELECT trip_id, seq AS stop_sequence, stop_id AS sched_stop_id, departure AS scheduled FROM stop_times)"
_PREDICT = """, predictions AS (SELECT l_orderkey AS trip_id, CAST(l_linenumber AS INT) AS stop_sequence, CASE WHEN l_tax < 0.03 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS stop_id, CASE WHEN l_returnflag = 'A' THEN '' ELSE CAST(l_partkey % 40 AS VARCHAR) END AS route_id,
    CASE WHEN l_linestatus = 'O' THEN CAST(30000 + l_quantity * 60 AS BIGINT) END AS observed, CASE WHEN l_discount >= 0.05 THEN CAST(l_quantity * 10 AS INT) END AS delay_s FROM lineitem),
    joined AS (SELECT p.trip_id, p.stop_sequence, coalesce(nullif(p.stop_id, ''), CAST(sched_stop_id AS VARCHAR), '') AS stop_id, coalesce(nullif(p.route_id, ''), CAST(t.route_id AS VARCHAR), '') AS route_id, coalesce(nullif(p.stop_id, '') <> CAST(sched_stop_id AS VARCHAR), FALSE) AS stop_differs, scheduled, observed, delay_s FROM predictions p LEFT JOIN schedule s USING (trip_id, stop_sequence) LEFT JOIN trips t ON t.trip_id = p.trip_id)"""


def _joined(spark, d) -> DataFrame:
    li = v.table(spark, d, "lineitem")
    p = li.select(F.lit("v").alias("version"), F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").cast("int").alias("stop_sequence"), F.when(F.col("l_tax") < 0.03, "").otherwise(F.col("l_suppkey").cast("string")).alias("stop_id"), F.when(F.col("l_returnflag") == "A", "").otherwise((F.col("l_partkey") % 40).cast("string")).alias("route_id"), F.when(F.col("l_linestatus") == "O", (30000 + F.col("l_quantity") * 60).cast("long")).alias("observed"), F.when(F.col("l_discount") >= 0.05, (F.col("l_quantity") * 10).cast("int")).alias("delay_s"))
    schedule = v.stop_times(spark, d).select(F.lit("v").alias("version"), "trip_id", F.col("seq").alias("stop_sequence"), F.col("stop_id").cast("string").alias("sched_stop_id"), F.col("departure").alias("scheduled"))
    return con.with_schedule(p, schedule, v.trips(spark, d).select("trip_id", F.col("route_id").cast("string").alias("sched_route_id")))


@query(f"{_SCHEDULE} {_PREDICT} SELECT trip_id, stop_sequence, stop_id, route_id, stop_differs, scheduled FROM joined", "stop_times", "trips")
def observation_schedule_join(spark, d):
    return _joined(spark, d).select("trip_id", "stop_sequence", "stop_id", "route_id", "stop_differs", "scheduled")


_PROVENANCE = """, prov AS (SELECT trip_id, stop_sequence, coalesce(observed, scheduled + delay_s) AS observed, CAST(coalesce(delay_s, coalesce(observed, scheduled + delay_s) - scheduled) AS INT) AS delay_s,
    CASE WHEN observed IS NOT NULL THEN 'transmitted' WHEN scheduled + delay_s IS NOT NULL THEN 'synthesised' ELSE 'absent' END AS time_origin, CASE WHEN delay_s IS NOT NULL THEN 'declared' WHEN observed - scheduled IS NOT NULL THEN 'derived' ELSE 'absent' END AS delay_origin FROM joined)"""


@query(f"{_SCHEDULE} {_PREDICT} {_PROVENANCE} SELECT * FROM prov WHERE observed IS NOT NULL", "stop_times", "trips")
def observation_provenance(spark, d):
    return con.with_provenance(_joined(spark, d)).select("trip_id", "stop_sequence", "observed", "delay_s", "time_origin", "delay_origin")


@query(f"{_SCHEDULE} {_PREDICT} SELECT count(*) AS n, CAST(count(*) FILTER (WHERE scheduled IS NULL) AS BIGINT) AS missing, count(DISTINCT CASE WHEN scheduled IS NULL THEN trip_id END) AS missing_trips, CAST(count(*) FILTER (WHERE scheduled IS NULL AND delay_s IS NOT NULL) AS BIGINT) AS missing_with_delay, round(quantile_cont(CASE WHEN scheduled IS NULL THEN delay_s END, 0.5), 6) AS missing_median FROM joined", "stop_times", "trips")
def missing_schedule(spark, d):
    j = checkpointed(_joined(spark, d).select("trip_id", "scheduled", "delay_s"))
    none = F.col("scheduled").isNull()
    median = exact_quantiles(j.filter(none), "delay_s", (0.5,))[0]
    return j.agg(F.count("*").alias("n"), F.count(F.when(none, 1)).alias("missing"), F.countDistinct(F.when(none, F.col("trip_id"))).alias("missing_trips"), F.count(F.when(none, F.col("delay_s"))).alias("missing_with_delay")).withColumn("missing_median", F.round(F.lit(median).cast("double"), 6))


_ABSENT = """, known AS (SELECT DISTINCT trip_id, service_date, 1 AS known FROM trips t JOIN active a ON a.service_id = t.service_id AND a.day = t.service_date),
    lacking AS (SELECT DISTINCT j.trip_id, service_date FROM joined j LEFT JOIN trips t ON t.trip_id = j.trip_id WHERE scheduled IS NULL)"""


@query(f"{_DAYS} {_SCHEDULE} {_PREDICT} {_ABSENT} SELECT CAST(l.service_date AS VARCHAR) AS day, count(*) AS trips, count(*) - count(known) AS absent, round((count(*) - count(known)) / count(*), 6) AS absent_share FROM lacking l LEFT JOIN known k ON k.trip_id = l.trip_id AND k.service_date = l.service_date GROUP BY l.service_date", "stop_times", "trips", "calendar", "calendar_dates")
def absent_trips(spark, d):
    """By service day, the trips with predictions that meet no scheduled time, and those of them that don't run that day by the timetable."""
    t = v.trips(spark, d)
    days = t.select("trip_id", F.col("service_date").alias("day"), "service_id")
    active = ser.services_by_day(v.calendar(spark, d), v.calendar_dates(spark, d), days.select("day").distinct())
    rows = _joined(spark, d).join(days.select("trip_id", "day"), "trip_id", "left")
    out = dia.absent_trips(rows, days.join(active, ["day", "service_id"]), "day")
    return out.withColumn("day", F.col("day").cast("string"))


KEY = ("trip_id", "stop_sequence")


@query("SELECT event_id, trip_id, stop_sequence, coarse FROM (SELECT *, lag(coarse) OVER w AS p, row_number() OVER w AS r FROM observations WINDOW w AS (PARTITION BY trip_id, stop_sequence ORDER BY feed_ts, event_id)) WHERE r = 1 OR p IS DISTINCT FROM coarse", "observations")
def change_dedup(spark, d):
    return con.change_dedup(v.observations(spark, d), ORDER, "coarse", KEY).select("event_id", "trip_id", "stop_sequence", "coarse")


@query("SELECT event_id, trip_id, stop_sequence, CAST(service_date AS VARCHAR) AS service_date, observed FROM observations QUALIFY row_number() OVER (PARTITION BY trip_id, stop_sequence, service_date ORDER BY feed_ts DESC, event_id DESC) = 1", "observations")
def last_per_passage(spark, d):
    return con.last_per_passage(v.observations(spark, d), ORDER).select("event_id", "trip_id", "stop_sequence", F.col("service_date").cast("string").alias("service_date"), "observed")


@query("SELECT event_id, trip_id, stop_sequence, lead_at_least FROM observations, (SELECT unnest([0, 120, 300]) AS lead_at_least) WHERE observed - feed_ts >= lead_at_least QUALIFY row_number() OVER (PARTITION BY trip_id, stop_sequence, lead_at_least ORDER BY feed_ts DESC, event_id DESC) = 1", "observations")
def lead_bucket_policy(spark, d):
    o = v.observations(spark, d).withColumn("lead_s", F.col("observed") - F.col("feed_ts"))
    return con.last_before_leads(o, (0, 120, 300), ORDER, key=KEY).select("event_id", "trip_id", "stop_sequence", "lead_at_least")


@query("""SELECT count(*) AS n_rows, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE a AND NOT b) AS BIGINT) AS suppressed, CAST(count(*) FILTER (WHERE NOT a AND b) AS BIGINT) AS duplicated FROM (
    SELECT row_number() OVER x = 1 OR lag(coarse) OVER x IS DISTINCT FROM coarse AS a, row_number() OVER y = 1 OR lag(coarse) OVER y IS DISTINCT FROM coarse AS b FROM observations WINDOW x AS (PARTITION BY service_date, trip_id, stop_sequence ORDER BY feed_ts, event_id), y AS (PARTITION BY trip_id, stop_sequence ORDER BY feed_ts, event_id))""", "observations")
def dedup_shadow_counters(spark, d):
    return con.shadow_counters(v.observations(spark, d), ORDER, "coarse")


@query("SELECT count(*) AS updates, CAST(count(*) FILTER (WHERE delay_s > 0) AS BIGINT) AS kept, count(DISTINCT (service_date, trip_id, stop_sequence)) AS passages, count(DISTINCT trip_id) AS trips, round(count(*) FILTER (WHERE delay_s > 0) / count(*), 6) AS kept_share FROM observations", "observations")
def consolidation_summary(spark, d):
    return con.consolidation_summary(v.observations(spark, d), F.col("delay_s") > 0)


@query(f"{_ON_DAY} SELECT trip_id, count(*) AS n, CAST(min(service_date) AS VARCHAR) AS first_date FROM observations WHERE trip_id NOT IN (SELECT trip_id FROM trips WHERE service_id IN (SELECT service_id FROM active)) GROUP BY trip_id", "observations", "trips", "calendar", "calendar_dates")
def trips_without_schedule(spark, d):
    """Observed trips that the timetable of a day doesn't have."""
    runs = ser.active_trips(v.trips(spark, d), ser.active_services(v.calendar(spark, d), v.calendar_dates(spark, d), DAY)).select("trip_id")
    o = v.observations(spark, d).join(runs, "trip_id", "left_anti")
    return o.groupBy("trip_id").agg(F.count("*").alias("n"), F.min("service_date").cast("string").alias("first_date"))


# Transfers


@query("SELECT s_suppkey AS stop_id, CAST(round_even((lon - lon0) * cos(radians(lat0)) * 111320.0, 0) AS BIGINT) AS x_m, CAST(round_even((lat - lat0) * 111320.0, 0) AS BIGINT) AS y_m FROM (SELECT *, 41 + s_suppkey % 97 / 256.0 AS lat, 12 + s_suppkey % 89 / 256.0 AS lon FROM supplier), (SELECT avg(41 + s_suppkey % 97 / 256.0) AS lat0, avg(12 + s_suppkey % 89 / 256.0) AS lon0 FROM supplier)")
def planar_projection(spark, d):
    k = F.col("s_suppkey")
    s = v.table(spark, d, "supplier").select(k.alias("stop_id"), (41 + k % 97 / 256.0).alias("stop_lat"), (12 + k % 89 / 256.0).alias("stop_lon"))
    return geo.project(s).select("stop_id", "x_m", "y_m")


@query("SELECT CAST(floor(x_m / 250.0) AS BIGINT) AS i, CAST(floor(y_m / 250.0) AS BIGINT) AS j, count(*) AS stops FROM stops GROUP BY ALL", "stops")
def grid_cells(spark, d):
    return v.stops(spark, d).groupBy(geo.cell(F.col("x_m"), 250).alias("i"), geo.cell(F.col("y_m"), 250).alias("j")).agg(F.count("*").alias("stops"))


@query("SELECT * FROM walks", "walks")
def walking_bands(spark, d):
    return tra.walks(v.stops(spark, d))


@query("SELECT a.stop_id AS from_stop_id, b.stop_id AS to_stop_id, (a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m) AS d2 FROM stops a, stops b WHERE a.stop_id <> b.stop_id AND (a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m) <= 62500", "stops")
def candidate_pairs_grid(spark, d):
    return tra.candidates_grid(v.stops(spark, d)).filter("d2 <= 62500")


@query("SELECT * FROM same_station", "same_station")
def same_station_pairs(spark, d):
    return tra.same_station(v.stops(spark, d))


@query("SELECT * FROM transfers", "transfers", stops=v.ONE_SQUARE)
def min_transfer_time(spark, d):
    return tra.min_transfer_times(v.stops(spark, d, districts=False), v.declared(spark, d))


@query("SELECT DISTINCT from_stop_id, to_stop_id FROM transfers JOIN serves s ON s.stop_id = to_stop_id WHERE NOT EXISTS (SELECT 1 FROM serves f WHERE f.stop_id = from_stop_id AND f.route_id = s.route_id)", "transfers", "serves")
def useful_transfers(spark, d):
    return tra.useful(tra.min_transfer_times(v.stops(spark, d), v.declared(spark, d)), v.serves(spark, d))


def _accessible(spark, d, out: DataFrame) -> DataFrame:
    t = tra.min_transfer_times(v.stops(spark, d), v.declared(spark, d))
    return tra.accessible(t, tra.accessible_stops(v.stops(spark, d), v.stations(spark, d)), out)


@query("SELECT * FROM accessible", "accessible")
def accessible_transfers(spark, d):
    return _accessible(spark, d, v.lifts_out(spark, d))


@query("SELECT from_stop_id, to_stop_id FROM transfers WHERE coalesce(walk_s <= 180, TRUE) AND from_stop_id IN (FROM accessible_stops) AND to_stop_id IN (FROM accessible_stops) EXCEPT SELECT * FROM accessible", "accessible")
def lift_outage_difference(spark, d):
    none = v.lifts_out(spark, d).limit(0)
    return _accessible(spark, d, none).subtract(_accessible(spark, d, v.lifts_out(spark, d)))


@query("""SELECT rule, CAST(stop_id AS VARCHAR) AS stop_id, CAST(detail AS BIGINT) AS detail FROM (
    SELECT 'V1' AS rule, from_stop_id AS stop_id, count(*) AS detail FROM transfers WHERE walk_s IS NOT NULL GROUP BY from_stop_id HAVING count(*) > 3
    UNION ALL SELECT 'V2', from_stop_id, min_transfer_time FROM transfers WHERE min_transfer_time < walk_s
    UNION ALL SELECT 'V3', s.stop_id, 2 FROM stops s JOIN stations p ON p.stop_id = s.parent_station AND p.wheelchair = 2 WHERE s.stop_id IN (SELECT from_stop_id FROM accessible)
    UNION ALL SELECT 'V4', from_stop_id, min_transfer_time FROM transfers WHERE min_transfer_time <= 0)""", "accessible", "stops", "stations")
def integrity_violations(spark, d):
    s, st = v.stops(spark, d), v.stations(spark, d)
    t = checkpointed(tra.min_transfer_times(s, v.declared(spark, d)))  # each rule reads it
    return tra.violations(s, st, t, tra.accessible(t, tra.accessible_stops(s, st), v.lifts_out(spark, d)), tra.Rules(most_walks=3))


@query("""SELECT t.from_stop_id, t.to_stop_id, min_transfer_time, walk_s IS NOT NULL AS on_foot, a.from_stop_id IS NOT NULL AS accessible, u.from_stop_id IS NOT NULL AS useful FROM transfers t LEFT JOIN accessible a ON a.from_stop_id = t.from_stop_id AND a.to_stop_id = t.to_stop_id
    LEFT JOIN (SELECT DISTINCT from_stop_id, to_stop_id FROM transfers JOIN serves s ON s.stop_id = to_stop_id WHERE NOT EXISTS (SELECT 1 FROM serves f WHERE f.stop_id = from_stop_id AND f.route_id = s.route_id)) u ON u.from_stop_id = t.from_stop_id AND u.to_stop_id = t.to_stop_id""", "accessible", "transfers", "serves")
def transfer_table(spark, d):
    return tra.transfer_table(v.stops(spark, d), v.stations(spark, d), v.declared(spark, d), v.serves(spark, d), v.lifts_out(spark, d), check=False)


@query(", reach(from_stop_id, to_stop_id) AS (SELECT stop_id, stop_id FROM stops UNION SELECT r.from_stop_id, t.to_stop_id FROM reach r JOIN transfers t ON t.from_stop_id = r.to_stop_id) SELECT * FROM reach", "transfers", recursive=True)
def transfer_closure(spark, d):
    s = v.stops(spark, d)
    return tra.closure(s.select("stop_id"), tra.min_transfer_times(s, v.declared(spark, d)))


@query(", reach(from_stop_id, to_stop_id) AS (SELECT stop_id, stop_id FROM accessible_stops UNION SELECT r.from_stop_id, t.to_stop_id FROM reach r JOIN accessible t ON t.from_stop_id = r.to_stop_id) SELECT * FROM reach", "accessible", recursive=True)
def accessible_closure(spark, d):
    ok = tra.accessible_stops(v.stops(spark, d), v.stations(spark, d))
    return tra.closure(ok, _accessible(spark, d, v.lifts_out(spark, d)))


@query("SELECT stop_id, x_m * x_m + y_m * y_m AS d2 FROM stops ORDER BY d2, stop_id LIMIT 20", "stops")
def nearest_stops(spark, d):
    return tra.nearest_stops(v.stops(spark, d), 0, 0, 20).select("stop_id", "d2")


@query("SELECT stop_id, round((x_m - mx) * (x_m - mx) + (y_m - my) * (y_m - my), 6) AS d2 FROM stops, (SELECT avg(x_m) AS mx, avg(y_m) AS my FROM stops) ORDER BY d2, stop_id LIMIT 1", "stops")
def central_stop(spark, d):
    return tra.central_stop(v.stops(spark, d))


@query("""SELECT 'stop' AS fact, count(*) AS n FROM stops UNION ALL SELECT 'coordinates', count(*) FILTER (WHERE x_m IS NOT NULL AND y_m IS NOT NULL) FROM stops UNION ALL SELECT 'cell', count(DISTINCT (floor(x_m / 250.0), floor(y_m / 250.0))) FROM stops
    UNION ALL SELECT 'station', count(DISTINCT parent_station) FROM stops UNION ALL SELECT 'access', count(*) FROM accessible_stops UNION ALL SELECT 'serves', count(*) FROM serves UNION ALL SELECT 'declared', count(*) FROM declared UNION ALL SELECT 'lift', count(*) FROM lifts_out""", "stops", "accessible_stops", "serves", "declared", "lifts_out")
def fact_counts(spark, d):
    """How many facts of each kind the transfer rules are given."""
    s = v.stops(spark, d)
    return tra.fact_counts(s, v.stations(spark, d), v.serves(spark, d), v.declared(spark, d), v.lifts_out(spark, d))


# Diagnostics

_ROLL = "abs(abs(delay_s * 30) - 86400) <= 3600"


def _roll(spark, d) -> DataFrame:
    return v.observations(spark, d).withColumn("delay_s", F.col("delay_s") * 30)


@query(f"SELECT count(*) AS n, CAST(count(*) FILTER (WHERE {_ROLL}) AS BIGINT) AS rollover, CAST(count(*) FILTER (WHERE abs(delay_s * 30) > 72000) AS BIGINT) AS large, count(DISTINCT trip_id) FILTER (WHERE {_ROLL}) AS rollover_trips, count(DISTINCT trip_id) FILTER (WHERE abs(delay_s * 30) > 72000) AS large_trips, CAST(count(*) FILTER (WHERE abs(delay_s * 30) > 72000 AND NOT {_ROLL}) AS BIGINT) AS residual FROM observations", "observations")
def rollover_rows(spark, d):
    return dia.rollover_shares(_roll(spark, d), times.is_rollover(F.col("delay_s")), F.abs("delay_s") > 72000)


@query("SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE r <= 10) AS BIGINT) AS top, round(sum(n) FILTER (WHERE r <= 10) / sum(n), 6) AS share FROM (SELECT trip_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, trip_id) AS r FROM observations WHERE abs(delay_s * 30) > 72000 GROUP BY trip_id)", "observations")
def large_delay_concentration(spark, d):
    return dia.concentration(_roll(spark, d).filter(F.abs("delay_s") > 72000), "trip_id")


@query("SELECT CAST(round_even(delay_s / 300.0, 0) * 5 AS INT) AS minutes, count(*) AS n, round(count(*) / (SELECT count(*) FROM observations), 6) AS share FROM observations GROUP BY minutes ORDER BY n DESC, minutes LIMIT 8", "observations")
def recurrent_delays(spark, d):
    return dia.most_common(v.observations(spark, d).withColumn("minutes", times.five_minutes(F.col("delay_s"))), "minutes")


@query("SELECT count(*) AS trips, round(quantile_cont(s, 0.5), 6) AS median_std, round(quantile_cont(m, 0.5), 6) AS median_mean, round(quantile_cont(n, 0.5), 6) AS median_size FROM (SELECT stddev_samp(delay_s) AS s, avg(delay_s) AS m, count(*) AS n FROM observations GROUP BY trip_id HAVING count(*) > 1)", "observations")
def within_trip_dispersion(spark, d):
    return dia.dispersion(v.observations(spark, d))


@query("SELECT trip_id, stop_sequence, count(DISTINCT service_date) AS dates FROM observations GROUP BY ALL HAVING dates > 1", "observations")
def multi_date_pairs(spark, d):
    return dia.several_dates(v.observations(spark, d))


@query("SELECT o.mode, count(*) AS n, count(m.stop_id) AS shared, round(count(m.stop_id) / count(*), 6) AS share, count(m.stop_id) >= 3000 AS decidable FROM (SELECT l_suppkey AS stop_id, ['tram', 'metro', 'rail', 'bus'][CAST(l_partkey % 4 AS INT) + 1] AS mode FROM lineitem) o LEFT JOIN (SELECT l_suppkey AS stop_id FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey % 4) > 1) m USING (stop_id) GROUP BY o.mode")
def shared_stop_modes(spark, d):
    return dia.shared_stops(v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stop_id"), v.mode_of(F.col("l_partkey")).alias("mode")))


_ANOMALOUS = ", marked AS (SELECT trip_id, seq AS stop_sequence, stop_id % 5 < 2 AS anomalous FROM stop_times)"


def _marked(spark, d) -> DataFrame:
    return v.stop_times(spark, d).select("trip_id", F.col("seq").alias("stop_sequence"), (F.col("stop_id") % 5 < 2).alias("anomalous"))


@query(f"{_ANOMALOUS}, runs AS (SELECT *, stop_sequence - row_number() OVER (PARTITION BY trip_id, anomalous ORDER BY stop_sequence) AS run FROM marked) SELECT trip_id, count(*) AS stops, CAST(count(*) FILTER (WHERE anomalous) AS BIGINT) AS anomalous_stops, count(DISTINCT CASE WHEN anomalous THEN run END) AS runs, CAST(min(CASE WHEN anomalous THEN stop_sequence END) AS INT) AS first_rank, round(count(*) FILTER (WHERE anomalous) / count(*), 6) AS share FROM runs GROUP BY trip_id HAVING anomalous_stops > 0", "stop_times")
def anomaly_islands(spark, d):
    return dia.islands(_marked(spark, d))


@query(f"{_ANOMALOUS} SELECT trip_id, stop_sequence, anomalous FROM marked WHERE trip_id IN (SELECT trip_id FROM marked WHERE anomalous) AND NOT anomalous", "stop_times")
def normal_stops_of_anomalous_trips(spark, d):
    return dia.normal_stops_of_anomalous_trips(_marked(spark, d)).select("trip_id", "stop_sequence", "anomalous")


_DUMPS = ", seen AS (SELECT event_id, trip_id, stop_sequence, delay_s, CAST(hour(to_timestamp(feed_ts)  AT TIME ZONE 'UTC') AS INT) AS hour, CAST(floor(feed_ts / 21600.0) AS BIGINT) AS dump FROM observations)"
_PASSED = ", passed AS (SELECT * EXCLUDE (l, t) FROM (SELECT *, max(dump) OVER (PARTITION BY trip_id, stop_sequence) AS l, max(dump) OVER (PARTITION BY trip_id) AS t FROM seen) WHERE dump = l AND l < t)"


def _seen(spark, d) -> DataFrame:
    return v.observations(spark, d).select("event_id", "trip_id", "stop_sequence", "delay_s", times.local_hour(F.col("feed_ts"), "UTC").alias("hour"), F.floor(F.col("feed_ts") / 21600).cast("long").alias("dump"))


@query(f"{_DUMPS} {_PASSED} SELECT event_id, trip_id, stop_sequence, dump FROM passed", "observations")
def passage_filter(spark, d):
    return dia.passage_filter(_seen(spark, d)).select("event_id", "trip_id", "stop_sequence", "dump")


@query(f"{_DUMPS} {_PASSED}, a AS (SELECT hour, count(*) AS n_all, round(quantile_cont(delay_s, 0.5), 6) AS median_all FROM seen GROUP BY hour), b AS (SELECT hour, count(*) AS n_passed, round(quantile_cont(delay_s, 0.5), 6) AS median_passed FROM passed GROUP BY hour) SELECT * FROM a FULL JOIN b USING (hour)", "observations")
def passage_filter_by_hour(spark, d):
    s = _seen(spark, d)
    return dia.hourly_both(s, dia.passage_filter(s))


@query(f"{_DUMPS}, k AS (SELECT dump, row_number() OVER (ORDER BY dump) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT dump FROM seen)) SELECT dump, k // greatest(3, n // 5) AS block FROM k WHERE k % greatest(3, n // 5) < 3 AND k // greatest(3, n // 5) < 5", "observations")
def evenly_spaced_blocks(spark, d):
    return dia.even_blocks(_seen(spark, d).select("dump").distinct(), 5, 3)


_BLOCKS = ", first AS (SELECT trip_id, min(departure) AS first_departure, max(arrival) AS last_arrival FROM stop_times GROUP BY trip_id), placed AS (SELECT trip_id, block_id, last_arrival, row_number() OVER (PARTITION BY block_id ORDER BY first_departure, trip_id) AS place FROM trips JOIN first USING (trip_id))"


@query(f"{_BLOCKS} SELECT a.trip_id, b.trip_id AS next_trip_id, CAST(b.place - a.place AS INT) AS step FROM placed a JOIN placed b ON a.block_id = b.block_id AND b.place - a.place BETWEEN 1 AND 2 WHERE a.last_arrival >= 60000 AND b.last_arrival < 60000", "trips", "stop_times")
def block_successors(spark, d):
    first = v.stop_times(spark, d).groupBy("trip_id").agg(F.min("departure").alias("first_departure"), F.max("arrival").alias("last_arrival"))
    return dia.block_successors(v.trips(spark, d).join(first, "trip_id"), first.filter("last_arrival >= 60000").select("trip_id"))


@query("SELECT DISTINCT trip_id FROM stop_times WHERE arrival >= 86400 OR departure >= 86400", "stop_times")
def trips_past_midnight(spark, d):
    return v.stop_times(spark, d).filter(times.past_midnight(F.col("arrival")) | times.past_midnight(F.col("departure"))).select("trip_id").distinct()


# Collection

_COVER = "CAST(count(*) FILTER (WHERE outcome = 'saved') AS BIGINT) AS saved, CAST(count(*) FILTER (WHERE outcome = 'duplicate') AS BIGINT) AS duplicate, CAST(count(*) FILTER (WHERE outcome = 'rejected') AS BIGINT) AS rejected, CAST(count(*) FILTER (WHERE outcome = 'failed') AS BIGINT) AS failed, count(*) AS polls, round(count(*) FILTER (WHERE outcome IN ('saved', 'duplicate')) / count(*), 6) AS coverage"


@query(f"SELECT city, {_COVER} FROM polls GROUP BY city", "polls")
def poll_coverage(spark, d):
    return dia.coverage(v.polls(spark, d), "city")


@query(f"SELECT city, CAST(floor(instant / 3600.0) AS BIGINT) AS hour, {_COVER} FROM polls GROUP BY ALL", "polls")
def hourly_poll_summary(spark, d):
    return dia.coverage(v.polls(spark, d).withColumn("hour", F.floor(F.col("instant") / 3600).cast("long")), "city", "hour")


@query("SELECT city, p AS gap_start, instant AS gap_end, instant - p AS gap_s FROM (SELECT city, instant, lag(instant) OVER (PARTITION BY city ORDER BY instant) AS p FROM polls WHERE outcome IN ('saved', 'duplicate')) WHERE instant - p >= 3600", "polls")
def collection_gaps(spark, d):
    return dia.gaps(v.polls(spark, d), 3600)


@query(f"SELECT city, CAST(to_timestamp(instant) AT TIME ZONE '{TZ}' AS DATE)::VARCHAR AS day, CAST(count(*) FILTER (WHERE outcome IN ('saved', 'duplicate')) AS BIGINT) AS successes, round(count(*) FILTER (WHERE outcome IN ('saved', 'duplicate')) / count(*), 6) AS coverage, round(least(1.0, count(*) FILTER (WHERE outcome IN ('saved', 'duplicate')) * 600 / 86400.0), 6) AS real_coverage FROM polls GROUP BY ALL", "polls")
def daily_real_coverage(spark, d):
    return dia.real_coverage(v.polls(spark, d), 600, TZ).withColumn("day", F.col("day").cast("string"))


@query("SELECT city, event_id, feed_ts FROM (SELECT *, last_value(CASE WHEN feed_ts <> 0 THEN feed_ts END IGNORE NULLS) OVER (PARTITION BY city ORDER BY instant, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM polls) WHERE feed_ts = 0 OR p IS NULL OR p <> feed_ts", "polls")
def snapshot_dedup(spark, d):
    return dia.snapshot_dedup(v.polls(spark, d), ("city",), ("instant", "event_id")).select("city", "event_id", "feed_ts")


# Network


@query("SELECT * FROM network", "network")
def network_events(spark, d):
    return net.events(v.stop_times(spark, d), START, END)


@query(f"{_ON_DAY}, ev AS (SELECT trip_id, seq, stop_id, arrival, departure FROM stop_times WHERE departure >= {START} - 3600 AND arrival <= {END} + 3600 AND trip_id IN (SELECT trip_id FROM trips WHERE service_id IN (SELECT service_id FROM active))) SELECT *, lead(seq) OVER (PARTITION BY trip_id ORDER BY seq) AS next_seq FROM ev", "stop_times", "trips", "calendar", "calendar_dates")
def network_on_date(spark, d):
    services = ser.active_services(v.calendar(spark, d), v.calendar_dates(spark, d), DAY)
    return net.events_on(v.stop_times(spark, d), v.trips(spark, d), services, START, END)


@query(f"SELECT stop_id, CAST(row_number() OVER (PARTITION BY stop_id ORDER BY departure, trip_id, seq) AS INT) AS place, trip_id, seq, departure FROM network WHERE departure BETWEEN {START} AND {END}", "network")
def departures_index(spark, d):
    return net.departures_index(net.events(v.stop_times(spark, d), START, END), START, END)


@query(f"SELECT count(*) AS events, count(next_seq) AS on_board, CAST(count(*) FILTER (WHERE arrival <= {END}) AS BIGINT) AS alight, CAST(count(*) FILTER (WHERE departure BETWEEN {START} AND {END} AND next_seq IS NOT NULL) AS BIGINT) AS board, (SELECT count(*) FROM transfers) AS transfers FROM network", "network", "transfers", stops=v.ONE_SQUARE)
def network_size(spark, d):
    return net.network_size(net.events(v.stop_times(spark, d), START, END), tra.min_transfer_times(v.stops(spark, d, districts=False), v.declared(spark, d)), START, END)


_EDGES = ", steps AS (SELECT trip_id, seq, arrival - lag(departure) OVER w AS seconds, x_m - lag(x_m) OVER w AS dx, y_m - lag(y_m) OVER w AS dy FROM stop_times JOIN stops USING (stop_id) WINDOW w AS (PARTITION BY trip_id ORDER BY seq)), edges AS (SELECT trip_id, seq, seconds, sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) AS metres, sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) / seconds * 3.6 AS kmh FROM steps WHERE seconds > 0 AND dx * dx + dy * dy > 0)"


@query(f"{_EDGES} SELECT trip_id, seq, seconds, round(metres, 6) AS metres, round(kmh, 6) AS kmh FROM edges", "stop_times", "stops")
def edge_speeds(spark, d):
    return net.edges(v.stop_times(spark, d), v.stops(spark, d)).select("trip_id", "seq", "seconds", F.round("metres", 6).alias("metres"), F.round("kmh", 6).alias("kmh"))


@query(f"{_EDGES} SELECT count(*) AS n, round(max(kmh), 6) AS max_kmh, round(quantile_cont(kmh, 0.5), 6) AS p50, round(quantile_cont(kmh, 0.9), 6) AS p90, round(quantile_cont(kmh, 0.99), 6) AS p99, round(quantile_cont(kmh, 0.999), 6) AS p999, CAST(count(*) FILTER (WHERE kmh > 150) AS BIGINT) AS above FROM edges", "stop_times", "stops")
def speed_distribution(spark, d):
    return net.speed_distribution(net.edges(v.stop_times(spark, d), v.stops(spark, d)))


_LEGS = ", legs AS (SELECT t.trip_id AS leg_id, t.route_id, a.stop_id AS board_stop, b.stop_id AS alight_stop, a.departure FROM trips t JOIN stop_times a ON a.trip_id = t.trip_id AND a.seq = 1 JOIN stop_times b ON b.trip_id = t.trip_id AND b.seq = 2)"


@query(f"{_LEGS}, hits AS (SELECT leg_id, b.trip_id, b.seq AS board_seq, b.departure AS dep, arg_min(e.arrival, e.seq) AS arrival FROM legs JOIN trips t USING (route_id) JOIN stop_times b ON b.trip_id = t.trip_id AND b.stop_id = board_stop AND b.departure > legs.departure JOIN stop_times e ON e.trip_id = b.trip_id AND e.seq > b.seq AND e.stop_id = alight_stop GROUP BY ALL) SELECT leg_id, CAST(r AS INT) AS rank, trip_id, dep AS departure, arrival FROM (SELECT *, row_number() OVER (PARTITION BY leg_id ORDER BY dep, trip_id, board_seq) AS r FROM hits) WHERE r <= 2", "stop_times", "trips", trips=v.FORTY_ROUTES)
def recoveries_topk(spark, d):
    s, t = v.stop_times(spark, d), v.trips(spark, d, route="o_custkey % 40")
    a, b = s.filter("seq = 1"), s.filter("seq = 2")
    legs = t.join(a.select("trip_id", F.col("stop_id").alias("board_stop"), "departure"), "trip_id").join(b.select("trip_id", F.col("stop_id").alias("alight_stop")), "trip_id").withColumnRenamed("trip_id", "leg_id").select("leg_id", "route_id", "board_stop", "alight_stop", "departure")
    return net.recoveries(s, t, legs, 2)


# Labels, dumps and reports

_LABEL = "CASE route_type WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 2 THEN 'rail' WHEN 3 THEN 'bus' WHEN 4 THEN 'ferry' WHEN 5 THEN 'cable tram' WHEN 6 THEN 'aerial lift' WHEN 7 THEN 'funicular' WHEN 11 THEN 'trolleybus' WHEN 12 THEN 'monorail' ELSE 'other' END"


@query(f"SELECT mode, count(*) AS n, round(avg(delay_s), 6) AS mean FROM observations LEFT JOIN (SELECT trip_id, {_LABEL} AS mode FROM trips JOIN routes USING (route_id)) USING (trip_id) GROUP BY ALL".replace("SELECT mode,", "SELECT r.mode AS mode,").replace(") USING (trip_id) GROUP", ") r USING (trip_id) GROUP"), "observations", "routes")
def delay_by_route_type(spark, d):
    o = v.observations(spark, d).drop("mode").join(v.trips(spark, d).select("trip_id", "route_id"), "trip_id", "left")
    return modes.with_mode(o, v.routes(spark, d)).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("delay_s"), 6).alias("mean"))


@query("SELECT mode, count(*) AS hours, CAST(count(*) FILTER (WHERE median < 0) AS BIGINT) AS negative FROM (SELECT mode, hour(timezone('Europe/Rome', to_timestamp(feed_ts))) AS hour, quantile_cont(delay_s, 0.5) AS median FROM observations GROUP BY ALL) GROUP BY mode", "observations")
def negative_median_hours(spark, d):
    by_hour = v.observations(spark, d).groupBy("mode", times.local_hour(F.col("feed_ts"), TZ).alias("hour")).agg(F.percentile("delay_s", 0.5).alias("median"))
    return dia.negative_medians(by_hour, "mode")


@query("SELECT city, CAST(CAST(timezone('Europe/Rome', to_timestamp(p)) AS DATE) AS VARCHAR) AS day, count(*) AS gaps, round(sum(instant - p) / 3600.0, 6) AS hours FROM (SELECT city, instant, lag(instant) OVER (PARTITION BY city ORDER BY instant) AS p FROM polls WHERE outcome IN ('saved', 'duplicate')) WHERE instant - p >= 3600 GROUP BY ALL", "polls")
def gap_hours(spark, d):
    return dia.gap_hours(v.polls(spark, d), 3600, TZ).withColumn("day", F.col("day").cast("string"))


@query("SELECT city, feed, instant, CAST(CAST(t AS DATE) AS VARCHAR) AS local_date, strftime(t, '%H%M%S') || CASE WHEN n > 0 THEN '-' || n ELSE '' END || '.pb' AS name FROM (SELECT *, timezone('Europe/Rome', to_timestamp(instant)) AS t, row_number() OVER (PARTITION BY city, feed, instant ORDER BY event_id) - 1 AS n FROM (SELECT city, feed_ts AS feed, instant // 3600 * 3600 AS instant, event_id FROM polls))", "polls")
def dump_paths(spark, d):
    p = v.polls(spark, d).select("city", F.col("feed_ts").alias("feed"), (F.floor(F.col("instant") / 3600) * 3600).cast("long").alias("instant"), F.col("event_id").alias("order"))
    return sinks.dump_paths(p, TZ).select("city", "feed", "instant", F.col("local_date").cast("string").alias("local_date"), "name")


@query("SELECT event_id, trip_id, delay_s FROM observations ORDER BY delay_s DESC, event_id LIMIT 20", "observations")
def largest_delays(spark, d):
    return dia.examples(v.observations(spark, d).select("event_id", "trip_id", "delay_s"), 20, F.desc("delay_s"), "event_id")
