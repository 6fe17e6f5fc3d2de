"""Places of dumps, quarantine, the index of versions, archives, labels."""

import datetime as dt
import io
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from headway.functions import modes
from headway.operators import network, services
from headway.sources import dumps as dp
from headway.sources import sinks
from headway.streaming import realtime


def test_index_is_read_and_kept(spark, tmp_path):
    path = str(tmp_path / "index")
    assert sinks.read_index(spark, path).count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), sinks.INDEX)
    sinks.upsert_index(rows(("b", dt.date(2027, 2, 1), "x"), ("a", dt.date(2027, 3, 1), "y")), path)
    sinks.upsert_index(rows(("a", dt.date(2027, 3, 1), "z"), ("a", dt.date(2027, 1, 1), "w"), ("a", dt.date(2027, 1, 1), "v")), path)
    want = [("a", dt.date(2027, 1, 1), "w"), ("a", dt.date(2027, 3, 1), "z"), ("b", dt.date(2027, 2, 1), "x")]
    assert [tuple(r) for r in sinks.read_index(spark, path).collect()] == want
    (tmp_path / "index/part-extra.json").write_text('{"city": "c", "valid_fr\nnot json at all\n')
    assert sorted(map(tuple, sinks.read_index(spark, path).collect())) == want


def test_dump_paths_and_quarantine(spark, tmp_path):
    # an hour before midnight in London it is midnight in Oslo
    rows = [("o", "trips", 1_800_000_000, 1, b"good", None), ("o", "trips", 1_800_000_000, 2, b"", "empty"), ("o", "alerts", 1_800_000_000, 1, b"good", None), ("o", "trips", 1_800_055_800, 1, b"late", None)]
    df = spark.createDataFrame(rows, "city string, feed string, instant long, order int, content binary, error string")
    placed = sinks.dump_paths(df, "Europe/Oslo")
    got = {(r.feed, r.instant, r.order): (r.local_date, r.name) for r in placed.collect()}
    assert got == {("trips", 1_800_000_000, 1): (dt.date(2027, 1, 15), "090000.pb"), ("trips", 1_800_000_000, 2): (dt.date(2027, 1, 15), "090000-1.pb"), ("alerts", 1_800_000_000, 1): (dt.date(2027, 1, 15), "090000.pb"), ("trips", 1_800_055_800, 1): (dt.date(2027, 1, 16), "003000.pb")}
    good, bad = str(tmp_path / "dumps"), str(tmp_path / "bad")
    sinks.write_dumps(placed, good, bad)
    sinks.write_dumps(placed.limit(0), good, bad)
    assert spark.read.parquet(good).count() == 3 and [(r.name, r.error) for r in spark.read.parquet(bad).collect()] == [("090000-1.pb", "empty")]
    assert (tmp_path / "dumps/city=o/local_date=2027-01-16/feed=trips").is_dir()


def test_latest_archive(spark, tmp_path):
    for name in ("b/2027-01.zip", "a/2027-03.zip", "c/2027-02.tar.gz", "c/2027-09.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sinks.latest_archive(spark, str(tmp_path)).endswith("/a/2027-03.zip")
    assert sinks.latest_archive(spark, str(tmp_path), "no such thing") is None


@pytest.mark.parametrize("names, fine", [(["f/070000.pb", "g/065959.pb", "f/070100.pb"], True), (["f/070100.pb", "f/070000.pb"], False)])
def test_order_within_archives(spark, tmp_path, names, fine):
    with tarfile.open(tmp_path / "day.tar", "w") as tar:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = 1
            tar.addfile(info, io.BytesIO(b"x"))
    assert dp.read_dumps(spark, str(tmp_path)).count() == len(names)
    if fine:
        assert dp.read_dumps(spark, str(tmp_path), ordered=True).count() == len(names)
    else:
        with pytest.raises(Exception, match="comes after 070100"):
            dp.read_dumps(spark, str(tmp_path), ordered=True).collect()


def test_labels(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "route_id string, n int")
    routes = spark.createDataFrame([("a", 4), ("b", 9), ("c", None), ("a", 4)], "route_id string, route_type int")
    assert {r.route_id: r.mode for r in modes.with_mode(rows, routes).collect()} == {"a": "ferry", "b": "other", "c": None, "d": None}
    assert {r.m for r in spark.range(0, 14).select(modes.route_type_label(F.col("id")).alias("m")).collect()} == {*modes.ROUTE_TYPES.values(), "other"}


def test_network_of_a_date(spark):
    st = spark.createDataFrame([("t", 1, "a", 0, 10), ("t", 2, "b", 60, 70), ("u", 1, "a", 5, 20)], "trip_id string, seq int, stop_id string, arrival long, departure long")
    trips = spark.createDataFrame([("t", "on"), ("u", "off")], "trip_id string, service_id string")
    dates = spark.createDataFrame([("on", dt.date(2027, 5, 5), 1)], "service_id string, date date, exception_type int")
    at = lambda day: {(r.trip_id, r.seq, r.next_seq) for r in network.events_on(st, trips, services.active_services(None, dates, day), 0, 100).collect()}
    assert at(dt.date(2027, 5, 5)) == {("t", 1, 2), ("t", 2, None)} and at(dt.date(2027, 5, 6)) == set()


def test_transfers_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", 60), ("a", "gone", 60), ("gone", "b", 60)], "from_stop_id string, to_stop_id string, min_transfer_time int")
    sinks.write_transfers(rows, str(tmp_path / "t"))
    known = spark.createDataFrame([("a",), ("b",)], "stop_id string")
    assert [(r.from_stop_id, r.to_stop_id, r.min_transfer_time) for r in sinks.read_transfers(spark, str(tmp_path / "t"), known).collect()] == [("a", "b", 60)]


def test_polls_on_disk(spark, tmp_path):
    path, schema = str(tmp_path / "polls"), "city string, instant long, outcome string"
    for k in range(2):
        sinks.append_poll(spark.createDataFrame([("o", 100 + k, "saved")], schema), path)
    (tmp_path / "polls/part-broken.json").write_text('{"city": "o", "instant": "soon"\n{"city": "o", "instant": 7, "outcome": "failed"}\n')
    assert sorted(map(tuple, sinks.read_polls(spark, path, schema).collect())) == [("o", 7, "failed"), ("o", 100, "saved"), ("o", 101, "saved")]


def test_days_are_consolidated_once(spark, tmp_path):
    path, day, today = str(tmp_path / "obs"), dt.date(2027, 5, 1), dt.date(2027, 5, 3)
    kinds = {"feed_date": "date", "service_date": "date", "stop_sequence": "int", "scheduled": "long", "observed": "long", "delay_s": "int", "feed_ts": "long", "poll_ts": "long"}
    row = ("o", day, day, "t", "r", "s", 1, 10, 20, 10, 30, 31, "sent", "derived")
    df = spark.createDataFrame([row], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in sinks.OBSERVATIONS))
    assert sinks.to_consolidate(spark, path, "o", day, today)
    sinks.write_observations(df, path)
    sinks.verify(spark, path, "o", day, 1)
    assert not sinks.to_consolidate(spark, path, "o", day, today) and sinks.to_consolidate(spark, path, "o", day, today, again=True)
    assert sinks.to_consolidate(spark, path, "p", day, today)
    with pytest.raises(ValueError, match="isn't over"):
        sinks.to_consolidate(spark, path, "o", today, today)
    with pytest.raises(sinks.VerificationError, match="1 rows instead of 2"):
        sinks.verify(spark, path, "o", day, 2)
    assert {r.delay_origin for r in sinks.read_observations(spark, path).collect()} == {"derived"}


def test_poll_counts_by_hour(spark):
    rows = [(dt.datetime(2027, 5, 1, 8, 5), "o", "saved"), (dt.datetime(2027, 5, 1, 8, 59), "o", "failed"), (dt.datetime(2027, 5, 1, 9, 0), "o", "duplicate")]
    got = realtime.poll_summary(spark.createDataFrame(rows, "ts timestamp, city string, outcome string"), "ts", "city").orderBy("window.start").collect()
    assert [(r.window.start.hour, r.saved, r.duplicate, r.failed, r.polls) for r in got] == [(8, 1, 0, 1, 2), (9, 0, 1, 0, 1)]


# The data source of dumps


def tar_of(path, names, size=10, mode="w"):
    with tarfile.open(path, mode) as tar:
        for k, n in enumerate(names):
            info = tarfile.TarInfo(n)
            info.size = size
            tar.addfile(info, io.BytesIO(bytes([k % 256]) * size))


def test_an_archive_is_read_by_several_tasks(spark, tmp_path):
    names = [f"f/{h:02d}{m:02d}00.pb" for h in range(10) for m in range(60)] + ["f/notes.txt"]
    tar_of(tmp_path / "day.tar", names, 300_000)
    (tmp_path / "loose.pb").write_bytes(b"loose")
    rows = dp.read_dumps(spark, str(tmp_path), ordered=True)
    assert rows.rdd.getNumPartitions() >= 3
    got = rows.select("path", "name", "bytes", F.expr("substring(content, 1, 1)").alias("first"), F.octet_length("content").alias("n")).collect()
    assert len(got) == 601 and all(r.bytes == r.n for r in got)
    by_path = {r.path.rpartition("/")[2] if "!" not in r.path else r.path.rpartition("!")[2]: r for r in got}
    assert all(by_path[n].first == bytes([k % 256]) for k, n in enumerate(names[:600])) and by_path["loose.pb"].name == "loose.pb"
    assert dp.byte_total(spark, str(tmp_path)) == 600 * 300_000 + 5 and dp.byte_total(spark, str(tmp_path), "f") == 600 * 300_000
    with pytest.raises(Exception, match="no such place"):
        dp.read_dumps(spark, str(tmp_path / "no such place")).count()


def test_compressed_archives_and_empty_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert dp.read_dumps(spark, str(tmp_path / "none")).count() == 0 and dp.byte_total(spark, str(tmp_path / "none")) == 0
    tar_of(tmp_path / "a.tar.gz", ["x/070000.pb", "x/070100.pb"], mode="w:gz")
    tar_of(tmp_path / "b.tgz", ["x/080100.pb", "x/080000.pb"], mode="w:gz")
    assert sorted(r.name for r in dp.read_dumps(spark, str(tmp_path)).collect()) == ["070000.pb", "070100.pb", "080000.pb", "080100.pb"]
    with pytest.raises(Exception, match="comes after 080100"):
        dp.read_dumps(spark, str(tmp_path), ordered=True).collect()


def test_dumps_as_a_stream(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        realtime.run_available(dp.read_dump_stream(spark, str(folder)).select("path", "name", "bytes"), out, state)
        return sorted(r.name for r in spark.read.parquet(out).collect())

    tar_of(folder / "2027-05-01.tar", ["f/070000.pb", "f/070100.pb"])
    assert run() == ["070000.pb", "070100.pb"]
    # members that are added to the last archive, and a new one; nothing comes twice
    tar_of(folder / "2027-05-01.tar", ["f/070000.pb", "f/070100.pb", "f/070200.pb"])
    tar_of(folder / "2027-05-02.tar", ["f/060000.pb"])
    assert run() == ["060000.pb", "070000.pb", "070100.pb", "070200.pb"] == run()
    tar_of(folder / "2027-04-30.tar", ["f/050000.pb"])
    tar_of(folder / "2027-05-03.tar", ["f/050000.pb"])
    with pytest.raises(Exception, match="have been read"):
        run()


def test_counts_come_from_the_write(spark, tmp_path):
    path, day = str(tmp_path / "obs"), dt.date(2027, 5, 1)
    tar_of(tmp_path / "day.tar", ["f/070000.pb", "f/070100.pb", "f/070200.pb"], 7)
    kinds = {"feed_date": "date", "service_date": "date", "stop_sequence": "int", "scheduled": "long", "observed": "long", "delay_s": "int", "feed_ts": "long", "poll_ts": "long"}

    def to_rows(dumps):
        values = {"city": F.lit("o"), "feed_date": F.lit(day), "service_date": F.lit(day), "trip_id": F.lit("t"), "stop_sequence": F.lit(1), "observed": F.lit(5), "feed_ts": F.substring("name", 1, 6).cast("long")}
        rows = dumps.select(*(values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in sinks.OBSERVATIONS))
        return rows.crossJoin(spark.range(2).select(F.lit(None).alias("twice"))).drop("twice")

    got = sinks.consolidate(dp.read_dumps(spark, str(tmp_path)), to_rows, path, "o", day)
    assert got == {"dumps": 3, "bytes": 21, "rows": 6, "passages": 1, "first": 70000, "last": 70200}
    with pytest.raises(sinks.VerificationError, match="nulls in"):
        sinks.consolidate(dp.read_dumps(spark, str(tmp_path)), lambda d: to_rows(d).withColumn("observed", F.lit(None).cast("long")), path, "o", day)


# Streams that watch


def test_open_gaps_are_reported_without_a_success(spark, tmp_path):
    schema, folder, out = "city string, day int, instant long", tmp_path / "in", str(tmp_path / "out")
    write = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(folder))

    def start():
        stream = realtime.gap_alarms(spark.readStream.schema(schema).parquet(str(folder)), ("city", "day"), "instant", 2)
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()

    def seen(query, least):
        for _ in range(60):
            time.sleep(0.5)
            if query.exception() is not None:
                raise query.exception()
            rows = {tuple(r) for r in spark.read.schema("city string, day int, gap_start long, gap_end long, gap_s long").parquet(out).collect()} if (tmp_path / "out").is_dir() else set()
            if len(rows) >= least:
                return rows
        return rows

    write(("o", 1, 100), ("o", 1, 101), ("o", 1, 110), ("p", 1, 100))
    query = start()
    try:
        open_ = {("o", 1, 110, None, None), ("p", 1, 100, None, None)}
        assert seen(query, 3) == {("o", 1, 101, 110, 9)} | open_
    finally:
        query.stop()
    # another success ends the gap, after a restart; an old one ends none; the next day is a key of its own
    write(("o", 1, 150), ("p", 1, 90), ("o", 2, 1000))
    query = start()
    try:
        got = seen(query, 6)
        assert got >= {("o", 1, 101, 110, 9), ("o", 1, 110, 150, 40), *open_, ("o", 1, 150, None, None), ("o", 2, 1000, None, None)} and not any(r[2] == 90 for r in got)
    finally:
        query.stop()


def test_versions_are_checked_once_a_batch(spark, tmp_path):
    path, answers = str(tmp_path / "checks"), {("o", 1): "aa", ("o", 2): "aa", ("o", 3): None, ("o", 4): "bb", ("o", 5): "aa", ("p", 3): "aa"}

    def fetch(asked):
        known = spark.createDataFrame([(*k, m) for k, m in answers.items()], "city string, instant long, md5 string")
        return asked.join(known, ["city", "instant"], "left")

    job = realtime.version_job(path, fetch)
    ticks = lambda *rows: spark.createDataFrame(list(rows), "city string, instant long")
    found = lambda: {(r.batch, r.city, r.instant): (r.outcome, r.file, r.attempts) for r in realtime.version_checks(spark, path).collect()}
    job(ticks(("o", 1), ("o", 2)), 0)
    job(ticks(("o", 3), ("p", 3)), 1)
    before = found()
    assert before == {(0, "o", 1): ("new", "o/aa.zip", 1), (0, "o", 2): ("unchanged", "o/aa.zip", 1), (1, "o", 3): ("failed", None, 1), (1, "p", 3): ("new", "p/aa.zip", 1)}
    job(ticks(("o", 3), ("p", 3)), 1)
    assert found() == before  # a batch that is run again changes nothing
    answers["o", 3] = "bb"
    job(ticks(("o", 4), ("o", 5)), 2)  # asks for what failed again
    assert {k: v for k, v in found().items() if k[0] == 2} == {(2, "o", 3): ("new", "o/bb.zip", 2), (2, "o", 4): ("unchanged", "o/bb.zip", 1), (2, "o", 5): ("known", "o/aa.zip", 1)}
    job(ticks(), 3)
    assert len(found()) == 7


def test_manifest_and_heartbeats(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.csv").write_text("city,instant,outcome,bytes,path\no,100,saved,7,x.pb\no,soon,saved,7,x.pb\np,200,failed,,\n")
    assert sorted(map(tuple, sinks.read_manifest(spark, str(tmp_path / "m")).collect())) == [("o", 100, "saved", 7, "x.pb"), ("p", 200, "failed", None, None)]
    (tmp_path / "h.json").write_text('{"city": "o", "instant": 100}\n{"city": "o", "instant": 160}\nhalf a li\n{"city": "p", "instant": 40}\n')
    assert sorted(map(tuple, sinks.heartbeats(spark, str(tmp_path / "h.json"), 200, 60).collect())) == [("o", 160, 40, True), ("p", 40, 160, False)]
