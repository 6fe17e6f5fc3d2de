"""Realtime dumps: one protobuf message a file, in folders or tar archives, decoded in parallel.

The message is described at run time from the public field numbers, so no generated code is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.sources.archives import DumpSource

_NAME = r"(\d{2})(\d{2})(\d{2})\.pb$"


def read_dumps(spark: SparkSession, path: str, subfolder: str | None = None, ordered: bool = False) -> DataFrame:
    """(path, name, content, bytes) of all .pb files below `path`, loose or in tar archives, alike; those of one subfolder only, if asked.

    Their order is that of `name`, which is the time of day; later steps order by it, not by how files were read. ordered:
    an archive whose members of a folder aren't in that order is an error. See `DumpSource`.
    """
    spark.dataSource.register(DumpSource)
    return _inside(spark.read.format("dumps").option("ordered", ordered).load(path), subfolder)


def read_dump_stream(spark: SparkSession, path: str, subfolder: str | None = None, ordered: bool = True) -> DataFrame:
    """The same as a stream: files in the order of their paths, new members of the last archive as they are added."""
    spark.dataSource.register(DumpSource)
    return _inside(spark.readStream.format("dumps").option("ordered", ordered).load(path), subfolder)


def byte_total(spark: SparkSession, path: str, subfolder: str | None = None) -> int:
    """Bytes of all dumps below `path`, unpacked. Tar archives are asked for their headers only."""
    spark.dataSource.register(DumpSource)
    rows = _inside(spark.read.format("dumps").option("content", False).load(path), subfolder)
    return rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n


def _inside(rows: DataFrame, subfolder: str | None) -> DataFrame:
    if not subfolder:
        return rows
    return rows.filter(F.col("path").contains(f"/{subfolder}/") | F.col("path").contains(f"!{subfolder}/"))


def poll_instant(name: Column, day: Column, tz: str) -> Column:
    """Epoch seconds of a dump's local time in its name; 0 for other names."""
    part = lambda k: F.regexp_extract(name, _NAME, k).cast("int")
    ts = F.make_timestamp(F.year(day), F.month(day), F.day(day), part(1), part(2), part(3), F.lit(tz))
    return F.when(name.rlike(_NAME), F.unix_seconds(ts)).otherwise(F.lit(0).cast("long"))


@cache
def _message():
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    f = descriptor_pb2.FileDescriptorProto(name="realtime.proto", package="transit", syntax="proto2")
    T = descriptor_pb2.FieldDescriptorProto
    # Fixed values of the format: message: (field, number, type, repeated)
    shapes = {
        "Event": (("delay", 1, T.TYPE_INT32, 0), ("time", 2, T.TYPE_INT64, 0), ("uncertainty", 3, T.TYPE_INT32, 0)),
        "Stop": (("stop_sequence", 1, T.TYPE_UINT32, 0), ("arrival", 2, "Event", 0), ("departure", 3, "Event", 0), ("stop_id", 4, T.TYPE_STRING, 0), ("schedule_relationship", 5, T.TYPE_INT32, 0)),
        "Trip": (("trip_id", 1, T.TYPE_STRING, 0), ("start_time", 2, T.TYPE_STRING, 0), ("start_date", 3, T.TYPE_STRING, 0), ("schedule_relationship", 4, T.TYPE_INT32, 0), ("route_id", 5, T.TYPE_STRING, 0)),
        "Update": (("trip", 1, "Trip", 0), ("stop_time_update", 2, "Stop", 1), ("timestamp", 4, T.TYPE_UINT64, 0)),
        "Entity": (("id", 1, T.TYPE_STRING, 0), ("is_deleted", 2, T.TYPE_BOOL, 0), ("trip_update", 3, "Update", 0)),
        "Header": (("version", 1, T.TYPE_STRING, 0), ("incrementality", 2, T.TYPE_INT32, 0), ("timestamp", 3, T.TYPE_UINT64, 0)),
        "Feed": (("header", 1, "Header", 0), ("entity", 2, "Entity", 1)),
    }
    for name, fields in shapes.items():
        m = f.message_type.add(name=name)
        for n, number, kind, many in fields:
            x = m.field.add(name=n, number=number, label=T.LABEL_REPEATED if many else T.LABEL_OPTIONAL)
            if isinstance(kind, str):
                x.type, x.type_name = T.TYPE_MESSAGE, f".transit.{kind}"
            else:
                x.type = kind
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("transit.Feed"))


DECODED = "name string, feed_ts long, entity_idx int, stu_idx int, trip_id string, start_date string, route_id string, stop_id string, stop_sequence int, schedule_relationship int, time long, delay int, corrupt string"


def _optional(m, field: str):
    return getattr(m, field) if m.HasField(field) else None


def decode(dumps: DataFrame) -> DataFrame:
    """A row for each stop time of each trip update (DECODED), arrival before departure. A dump that can't be read gives one row that says why in `corrupt`."""
    names = [x.split()[0] for x in DECODED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                feed, rows = _message()(), []
                try:
                    feed.ParseFromString(content)
                    if not feed.header.version:
                        raise ValueError("no header version")
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame([(name, *[None] * 11, str(e)[:200])], columns=names)
                    continue
                for i, e in enumerate(feed.entity):
                    trip = e.trip_update.trip
                    for j, s in enumerate(e.trip_update.stop_time_update):
                        event = s.arrival if s.HasField("arrival") else s.departure
                        rows.append((name, feed.header.timestamp, i, j, trip.trip_id, trip.start_date, trip.route_id, s.stop_id, _optional(s, "stop_sequence"), s.schedule_relationship, _optional(event, "time"), _optional(event, "delay"), None))
                yield pd.DataFrame(rows, columns=names).astype({"stop_sequence": "Int32", "time": "Int64", "delay": "Int32"})

    return dumps.select("name", "content").mapInPandas(run, DECODED)


def to_predictions(decoded: DataFrame, day: Column) -> DataFrame:
    """Service date from start_date, else the folder's day; the columns that consolidation joins on; unreadable dumps go."""
    rows = decoded.filter("corrupt IS NULL").withColumn("service_date", F.coalesce(F.to_date(F.when(F.col("start_date").rlike(r"^\d{8}$"), F.col("start_date")), "yyyyMMdd"), day))
    return rows.withColumnsRenamed({"time": "observed", "delay": "delay_s"}).drop("corrupt", "start_date")


def payload_counts(dumps: DataFrame) -> DataFrame:
    """(name, problem, entities, updates, with_time, with_delay, with_neither) of payloads: empty ones, text instead of protobuf, and unreadable ones have a problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"]):
                problem, counts = None, [0] * 5
                if not content:
                    problem = "empty"
                elif content.lstrip()[:1] in (b"<", b"{"):
                    problem = "text"
                else:
                    try:
                        feed = _message()()
                        feed.ParseFromString(content)
                        problem = None if feed.header.version else "no version"
                        for e in feed.entity:
                            counts[0] += 1
                            for s in e.trip_update.stop_time_update:
                                events = [x for x in (s.arrival, s.departure)]
                                t, d = any(x.HasField("time") for x in events), any(x.HasField("delay") for x in events)
                                counts = [counts[0], counts[1] + 1, counts[2] + t, counts[3] + d, counts[4] + (not t and not d)]
                    except Exception:  # noqa: BLE001
                        problem = "unreadable"
                out.append((name, problem, *counts))
            yield pd.DataFrame(out, columns=["name", "problem", "entities", "updates", "with_time", "with_delay", "with_neither"])

    return dumps.select("name", "content").mapInPandas(run, "name string, problem string, entities long, updates long, with_time long, with_delay long, with_neither long")


def feed_verdict(counts: DataFrame) -> DataFrame:
    """(name, verdict): what a payload is good for."""
    c = F.col
    verdict = F.when(c("problem").isNotNull(), F.concat(F.lit("rejected: "), c("problem"))).when(c("updates") == 0, "no updates").when(c("with_delay") == c("updates"), "delays").when(c("with_time") == c("updates"), "times").when(c("with_neither") == c("updates"), "neither").otherwise("mixed")
    return counts.select("name", verdict.alias("verdict"))
