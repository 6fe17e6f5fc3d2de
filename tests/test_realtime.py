import datetime as dt
import tarfile

import pytest
import toy
from pyspark.sql import functions as F

from headway.operators import consolidation as con
from headway.operators import diagnostics as dia
from headway.sources import dumps as dp
from headway.sources import sinks
from headway.streaming import realtime as rt

KEY = ("service_date", "trip_id", "stop_sequence")


def message(ts, updates):
    """updates: (trip, start_date, seq, stop_id, time, delay)."""
    m = dp._message()()
    m.header.version, m.header.timestamp = "2.0", ts
    for trip, date, seq, stop, time, delay in updates:
        e = m.entity.add(id=f"{trip}{seq}")
        e.trip_update.trip.trip_id, e.trip_update.trip.start_date = trip, date
        s = e.trip_update.stop_time_update.add(stop_sequence=seq)
        s.stop_id = stop
        if time is not None:
            s.arrival.time = time
        if delay is not None:
            s.departure.delay = delay
    return m.SerializeToString()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("dumps") / "updates"
    root.mkdir()
    # the tram's arrival at the hill, predicted five times, then a page instead of a feed, then a delay at the mill
    for name, ts, late in (("071500", 50_000, 7), ("071547", 50_047, 9), ("071630", 50_090, 9), ("071702", 50_122, 9), ("071800", 50_180, 7)):
        (root / f"{name}.pb").write_bytes(message(ts, [("early", "20270823", 6, "", 26_300 + late, None)]))
    (root / "071811.pb").write_bytes(b"<html>busy</html>")
    (root / "071900.pb").write_bytes(message(50_240, [("early", "", 9, "MILL", None, -30)]))
    return root


def test_decode_and_poll_instant(spark, folder):
    rows = dp.decode(dp.read_dumps(spark, str(folder))).orderBy("name").collect()
    assert [r.time for r in rows[:5]] == [26307, 26309, 26309, 26309, 26307] and rows[5].corrupt and rows[6].delay == -30 and rows[6].time is None
    day = spark.createDataFrame([("071547.pb", toy.DAY), ("notes.txt", toy.DAY)], "n string, d date")
    at = int(dt.datetime(2027, 8, 23, 5, 15, 47, tzinfo=dt.UTC).timestamp())
    assert [r.i for r in day.select(dp.poll_instant(F.col("n"), F.col("d"), "Europe/Oslo").alias("i")).collect()] == [at, 0]


def test_archive_equals_folder(spark, folder, tmp_path):
    with tarfile.open(tmp_path / "day.tar.gz", "w:gz") as t:
        t.add(folder, "updates")
    a, b = (dp.decode(dp.read_dumps(spark, str(p), "updates")).drop("path") for p in (folder.parent, tmp_path))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr) and a.count() == 7


def test_counts_and_verdict(spark, folder):
    counts = dp.payload_counts(dp.read_dumps(spark, str(folder)))
    got = {r.name: r.verdict for r in dp.feed_verdict(counts).collect()}
    assert got["071500.pb"] == "times" and got["071811.pb"] == "rejected: text" and got["071900.pb"] == "delays"


def test_change_dedup_to_sink(spark, folder, tmp_path):
    p = dp.to_predictions(dp.decode(dp.read_dumps(spark, str(folder))), F.lit(toy.DAY)).withColumn("version", F.lit("v"))
    schedule = spark.createDataFrame([("v", "early", 6, "HILL", 26_290), ("v", "early", 9, "MILL", 27_060)], "version string, trip_id string, stop_sequence int, sched_stop_id string, scheduled long")
    routes = spark.createDataFrame([("early", "tram")], "trip_id string, sched_route_id string")
    rows = con.with_provenance(con.with_schedule(p, schedule, routes))
    kept = con.change_dedup(rows, ("feed_ts", "name", "entity_idx", "stu_idx"))
    got = {(r.stop_sequence, r.feed_ts): r for r in kept.collect()}
    assert set(got) == {(6, 50_000), (6, 50_047), (6, 50_180), (9, 50_240)}
    first, last = got[6, 50_000], got[9, 50_240]
    assert (first.stop_id, first.route_id, first.time_origin, first.delay_origin, first.delay_s) == ("HILL", "tram", "transmitted", "derived", 17)
    assert (last.stop_id, last.observed, last.time_origin, last.delay_origin) == ("MILL", 27_030, "synthesised", "declared")
    path = str(tmp_path / "obs")
    sinks.write_observations(kept.withColumns({"city": F.lit("harbour"), "feed_date": F.lit(toy.DAY), "poll_ts": F.lit(0)}), path)
    sinks.verify(spark, path, "harbour", toy.DAY, 4)
    assert sinks.read_observations(spark, path).count() == 4


@pytest.mark.parametrize("dates, values, want", [("abab", (1, 1, 1, 1), (2, 1, 0)), ("abab", (1, 2, 1, 2), (2, 0, 2))])
def test_shadow_counters(spark, dates, values, want):
    rows = [(dt.date(2026, 8, 1 if d == "a" else 2), "T", 1, k, v) for k, (d, v) in enumerate(zip(dates, values))]
    r = con.shadow_counters(spark.createDataFrame(rows, "service_date date, trip_id string, stop_sequence int, feed_ts int, observed int"), ("feed_ts",)).first()
    assert (r.kept, r.suppressed, r.duplicated) == want


def test_gaps_and_snapshots(spark):
    polls = spark.createDataFrame([("x", t, o) for t, o in ((0, "saved"), (60, "failed"), (200, "duplicate"), (260, "saved"))], "city string, instant long, outcome string")
    assert [tuple(r) for r in dia.gaps(polls, 180).collect()] == [("x", 0, 200, 200)]
    snaps = spark.createDataFrame([("f", k, ts) for k, ts in enumerate((5, 5, 0, 5, 4, None, 4))], "feed string, instant long, feed_ts long")
    assert [r.instant for r in dia.snapshot_dedup(snaps).orderBy("instant").collect()] == [0, 2, 4, 5]


def test_streams_go_on_after_a_restart(spark, tmp_path):
    schema = "trip_id string, feed_ts long, observed long"
    write = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    def run():
        stream = rt.change_dedup(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ("trip_id",), "feed_ts", "observed")
        rt.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted((r.feed_ts, r.observed) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    write([("T", 1, 10), ("T", 2, 10), ("T", 3, 11)], 0)
    assert run() == [(1, 10), (3, 11)]
    write([("T", 4, 11), ("T", 5, 10)], 1)
    assert run() == [(1, 10), (3, 11), (5, 10)]


def test_failing_job_does_not_stop_others():
    done = []

    def bad(df, epoch):
        raise ValueError("no")

    with pytest.raises(RuntimeError, match="schedule"):
        rt.isolated({"schedule": bad, "polls": lambda df, epoch: done.append(epoch)})(None, 7)
    assert done == [7]


def test_version_index_and_md5(spark):
    rows = [("x", k, m) for k, m in enumerate("aabba")]
    got = [(r.valid_from, r.version) for r in sinks.version_index(spark.createDataFrame(rows, "city string, day int, md5 string")).orderBy("valid_from").collect()]
    assert got == [(0, "a"), (2, "b"), (4, "a")]
    assert spark.createDataFrame([("D41D8CD98F00B204E9800998ECF8427E  f.zip",)], "t string").select(sinks.md5_of_file(F.col("t")).alias("m")).first().m == "d41d8cd98f00b204e9800998ecf8427e"


def test_trips_the_timetable_lacks(spark):
    rows = [("d1", 1, None), ("d1", 1, None), ("d1", 2, None), ("d1", 3, 60), ("d2", 2, None), (None, 4, None)]
    timetable = [("d1", 1), ("d1", 1), ("d1", 3), ("d2", 1), (None, 4)]
    rows, timetable = spark.createDataFrame(rows, "day string, trip_id int, scheduled int"), spark.createDataFrame(timetable, "day string, trip_id int")
    got = {r.day: (r.trips, r.absent, r.absent_share) for r in dia.absent_trips(rows, timetable, "day").collect()}
    assert got == {"d1": (2, 1, 0.5), "d2": (1, 1, 1.0), None: (1, 1, 1.0)}
    assert dia.absent_trips(rows.limit(0), timetable, "day").count() == 0
