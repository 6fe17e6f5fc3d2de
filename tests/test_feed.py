import datetime as dt
import zipfile

import pytest
import toy
from pyspark.sql import functions as F

from headway.functions import times
from headway.operators import services
from headway.sources import feed as fd


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    return fd.load_feed(spark, toy.write(tmp_path_factory.mktemp("feed")))


def column(df, name):
    return {r[name] for r in df.collect()}


def test_tables_are_typed(feed):
    assert column(fd.physical_stops(feed.stops), "stop_id") == {"QN", "QS", "QT", "HILL", "MILL", "LAMP"}
    night = {r.stop_id: (r.arrival_time, r.departure_time) for r in feed.stop_times.filter("trip_id = 'owl'").collect()}
    assert night == {"HILL": (85800, 85800), "QS": (86520, 86640), "LAMP": (96330, 96330)}
    assert column(feed.stop_times.filter(times.past_midnight(F.col("departure_time"))), "stop_id") == {"QS", "LAMP"}
    assert feed.tz == "Europe/Oslo" and "stops 9" in feed.describe() and feed.transfers is None


def test_zip_with_byte_order_marks(spark, tmp_path):
    folder = toy.write(tmp_path / "plain", without=("calendar",), bom=True)
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for name in toy.FILES.keys() - {"calendar"}:
            z.write(f"{folder}/{name}.txt", f"export/{name}.txt")
        z.writestr("__MACOSX/export/stops.txt", "junk")
    feed = fd.load_feed(spark, fd.unpacked(spark, str(tmp_path / "feed.zip"), str(tmp_path / "staging")), tz="Europe/Lisbon")
    assert feed.tz == "Europe/Lisbon" and feed.calendar is None
    assert column(feed.trips, "block_id") == {""} and column(feed.routes, "route_long_name") == {""} and feed.stops.count() == 9


# by day: the services that run, and their trips
DAYS = [
    (toy.DAY, {"EVERYDAY", "TERM"}, {"early", "owl", "noon"}),
    (dt.date(2027, 7, 4), {"EVERYDAY", "SUMMER"}, {"early", "owl", "out", "home"}),
    (dt.date(2027, 9, 8), {"EVERYDAY", "SUMMER", "TERM"}, {"early", "owl", "out", "home", "noon"}),
    (dt.date(2027, 10, 11), {"EVERYDAY"}, {"early", "owl"}),
    (dt.date(2027, 12, 24), set(), set()),
]


@pytest.mark.parametrize("day, on, trips", DAYS)
def test_what_runs_on_a_day(feed, day, on, trips):
    active = services.active_services(feed.calendar, feed.calendar_dates, day)
    assert column(active, "service_id") == on and column(services.active_trips(feed.trips, active), "trip_id") == trips


def test_all_days_at_once(spark, feed):
    days = spark.createDataFrame([(d,) for d, _, _ in DAYS], "day date")
    got: dict = {d: set() for d, _, _ in DAYS}
    for r in services.services_by_day(feed.calendar, feed.calendar_dates, days).collect():
        got[r.day].add(r.service_id)
    assert got == {d: on for d, on, _ in DAYS}


def test_days_without_a_weekly_calendar(feed):
    on = lambda day: column(services.active_services(None, feed.calendar_dates, day), "service_id")
    assert on(dt.date(2027, 9, 8)) == {"SUMMER"} and on(dt.date(2027, 9, 9)) == on(dt.date(2027, 12, 24)) == set()
    assert column(services.active_services(feed.calendar, None, dt.date(2027, 12, 24)), "service_id") == {"EVERYDAY"}
    with pytest.raises(ValueError, match="calendar"):
        services.active_services(None, None, toy.DAY)


def test_all_problems_at_once(spark, tmp_path):
    folder = toy.write(tmp_path / "bad", without=("routes", "calendar", "calendar_dates"))
    (tmp_path / "bad/stop_times.txt").write_text("trip_id,stop_id\nout,QN\n")
    with pytest.raises(fd.FeedError) as e:
        fd.load_feed(spark, folder)
    assert all(x in str(e.value) for x in ("routes.txt is missing", "neither calendar", "stop_sequence, arrival_time, departure_time"))


@pytest.mark.parametrize("text", ["7.30", "1:2:3", "11:07:60", "-2:00:00", "12:00:00 pm", "0:75:10"])
def test_times_that_are_none(spark, text):
    with pytest.raises(Exception, match="malformed time"):
        spark.createDataFrame([(text,)], "t string").select(times.parse_time(F.col("t"))).collect()


def test_times_and_dates(spark):
    df = spark.createDataFrame([(" 6:05:09",), ("100:00:00 ",), ("",), (None,)], "t string").select(times.parse_time(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [21909, 360000, None, None]
    # the nights in which clocks change, and an ordinary one
    days = spark.createDataFrame([(dt.date(2027, 3, 28), 21600), (dt.date(2027, 10, 31), 21600), (dt.date(2027, 6, 20), 100_000)], "d date, s int")
    at = days.select("s", F.from_utc_timestamp(F.timestamp_seconds(times.service_instant(F.col("d"), F.col("s"), "Europe/Oslo")), "Europe/Oslo").alias("t"), times.calendar_day(F.col("d"), F.col("s")).alias("on"))
    assert [(r.t, r.on) for r in at.collect()] == [(dt.datetime(2027, 3, 28, 6), dt.date(2027, 3, 28)), (dt.datetime(2027, 10, 31, 6), dt.date(2027, 10, 31)), (dt.datetime(2027, 6, 21, 3, 46, 40), dt.date(2027, 6, 21))]


def test_versions_in_force(spark):
    versions = spark.createDataFrame([("north", dt.date(2027, 2, 1), "n1"), ("north", dt.date(2027, 2, 1), "n2"), ("north", dt.date(2027, 4, 1), "n3"), ("south", dt.date(2027, 3, 1), "s1")], "city string, valid_from date, version string")
    rows = [("north", dt.date(2027, 1, 31)), ("north", dt.date(2027, 2, 1)), ("north", dt.date(2027, 3, 31)), ("north", dt.date(2028, 1, 1)), ("south", dt.date(2027, 2, 28)), ("south", dt.date(2027, 3, 2))]
    got = services.version_as_of(spark.createDataFrame(rows, "city string, service_date date"), versions, keys=("city",)).collect()
    assert {(r.city, r.service_date): r.version for r in got} == dict(zip(rows, [None, "n2", "n2", "n3", None, "s1"]))


def test_zip_is_unpacked_by_tasks(spark, tmp_path):
    """Files come from the zip or a folder in it; those of the outer folder win; other files stay."""
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("inner/stops.txt", "inner")
        z.writestr("inner/agency.txt", "a" * 3_000_000)
        z.writestr("__MACOSX/stops.txt", "junk")
        z.writestr("readme.md", "text")
    folder = fd.unpacked(spark, str(tmp_path / "f.zip"))
    found = fd.find_files(folder)
    assert set(found) == {"stops", "agency"} and open(found["agency"]).read() == "a" * 3_000_000
    assert fd.unpacked(spark, str(tmp_path)) == str(tmp_path)
    (tmp_path / "no.zip").write_text("not a zip")
    assert fd.unpacked(spark, str(tmp_path / "no.zip")) == str(tmp_path / "no.zip")
