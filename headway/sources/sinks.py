"""Observation and transfer tables on disk, written by day and verified on rereading."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from headway.operators.state import checkpointed

OBSERVATIONS = ("city", "feed_date", "service_date", "trip_id", "route_id", "stop_id", "stop_sequence", "scheduled", "observed", "delay_s", "feed_ts", "poll_ts", "time_origin", "delay_origin")
NOT_NULL = ("city", "service_date", "trip_id", "stop_sequence", "observed", "feed_ts")


class VerificationError(RuntimeError):
    """What was written isn't what is read."""


def write_observations(rows: DataFrame, path: str) -> dict:
    """Replaces the (city, feed_date) partitions that the rows have; others stay. Returns what was counted while writing.

    `rows` is how many were written, `nulls` how many of them break NOT_NULL, `passages` about how many passages they
    have, `first` and `last` the feed's times. The counts come from the pass that writes, not from a second one.
    """
    seen = Observation("written")
    broken = F.coalesce(F.sum(F.greatest(*(F.col(c).isNull().cast("int") for c in NOT_NULL))), F.lit(0))
    passages = F.approx_count_distinct(F.struct("service_date", "trip_id", "stop_sequence"))
    rows = rows.select(*OBSERVATIONS).repartition("city", "feed_date", F.pmod(F.xxhash64("trip_id"), F.lit(16)))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), broken.alias("nulls"), passages.alias("passages"), F.min("feed_ts").alias("first"), F.max("feed_ts").alias("last"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("city", "feed_date").parquet(path)
    return seen.get


def consolidate(dumps: DataFrame, to_rows: Callable[[DataFrame], DataFrame], path: str, city: str, day: dt.date) -> dict:
    """Turns a day's dumps into observations, writes and verifies them; returns dumps, bytes, rows, passages, first and last.

    to_rows makes observations of dumps(name, content, bytes, ...). Dumps and bytes are counted where they are read, rows
    where they are written, in the one job that does both; the partition is then reread and must have as many rows.
    """
    read = Observation("read")
    counted = to_rows(dumps.observe(read, F.count(F.lit(1)).alias("dumps"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")))
    written = write_observations(counted, path)
    if written["nulls"]:
        raise VerificationError(f"{written['nulls']} rows with nulls in {', '.join(NOT_NULL)}")
    verify(dumps.sparkSession, path, city, day, written["rows"])
    return read.get | {k: written[k] for k in ("rows", "passages", "first", "last")}


def verify(spark: SparkSession, path: str, city: str, day: dt.date, expected: int) -> None:
    """Rereads a partition: its columns, its row count and that NOT_NULL columns have no nulls."""
    df = spark.read.parquet(path)
    if set(df.columns) != set(OBSERVATIONS):
        raise VerificationError(f"columns {sorted(df.columns)}")
    part = df.filter((F.col("city") == city) & (F.col("feed_date") == F.lit(day)))
    row = part.agg(F.count("*").alias("n"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in NOT_NULL)).first()
    if row.n != expected:
        raise VerificationError(f"{row.n} rows instead of {expected}")
    if empty := [c for c in NOT_NULL if row[c]]:
        raise VerificationError(f"nulls in {', '.join(empty)}")


def is_consolidated(spark: SparkSession, path: str, city: str, day: dt.date) -> bool:
    """Whether the partition is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/city={city}/feed_date={day}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def to_consolidate(spark: SparkSession, path: str, city: str, day: dt.date, today: dt.date, again: bool = False) -> bool:
    """A day is done once, unless asked for again; the current day isn't over and is refused."""
    if day >= today:
        raise ValueError(f"{day} isn't over yet")
    return again or not is_consolidated(spark, path, city, day)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """All partitions; columns that older files lack are null."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.withColumns({c: F.lit(None).cast("string") for c in ("time_origin", "delay_origin") if c not in df.columns})


def write_transfers(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def read_transfers(spark: SparkSession, path: str, stops: DataFrame) -> DataFrame:
    """Transfers between known stops."""
    df = spark.read.parquet(path)
    for side in ("from_stop_id", "to_stop_id"):
        df = df.join(stops.select(F.col("stop_id").alias(side)), side, "left_semi")
    return df


def append_poll(rows: DataFrame, path: str) -> None:
    """The manifest or the gaps, as JSON lines."""
    rows.write.mode("append").json(path)


def read_polls(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


MANIFEST = "city string, instant long, outcome string, bytes long, path string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as comma-separated files with a header (MANIFEST); lines that can't be read or have no instant are skipped."""
    rows = spark.read.schema(MANIFEST).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return rows.filter("instant IS NOT NULL")


def heartbeats(spark: SparkSession, path: str, now: int, most_s: int) -> DataFrame:
    """(city, instant, silent_s, alive): each city's last sign of life in JSON lines (city, instant), and whether it is no older than most_s. Lines that can't be read are skipped."""
    rows = spark.read.schema("city string, instant long").option("mode", "DROPMALFORMED").json(path).filter("city IS NOT NULL AND instant IS NOT NULL")
    last = rows.groupBy("city").agg(F.max("instant").alias("instant")).withColumn("silent_s", F.lit(now) - F.col("instant"))
    return last.withColumn("alive", F.col("silent_s") <= most_s)


def version_index(days: DataFrame) -> DataFrame:
    """(city, valid_from, version): the days on which the timetable's md5 changed, from (city, day, md5)."""
    before = F.lag("md5").over(Window.partitionBy("city").orderBy("day"))
    return days.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("md5"))).select("city", F.col("day").alias("valid_from"), F.col("md5").alias("version"))


INDEX = "city string, valid_from date, version string"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of timetable versions; empty where it isn't there. Lines that can't be read are skipped."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], INDEX)
    rows = spark.read.schema(f"{INDEX}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.filter("broken IS NULL AND city IS NOT NULL AND valid_from IS NOT NULL").drop("broken")


def upsert_index(rows: DataFrame, path: str) -> None:
    """Adds versions (city, valid_from, version) to the index, in place of those of the same city and day; it is kept in order."""
    spark = rows.sparkSession
    new = rows.groupBy("city", "valid_from").agg(F.max("version").alias("version"))
    merged = read_index(spark, path).join(new, ["city", "valid_from"], "left_anti").unionByName(new)
    merged = checkpointed(merged)  # what is replaced has been read
    merged.coalesce(1).sortWithinPartitions("city", "valid_from").write.mode("overwrite").json(path)  # a row a city and timetable


def dump_paths(polls: DataFrame, tz: str, keys: tuple[str, ...] = ("city", "feed")) -> DataFrame:
    """polls(keys, instant, order) with the place of their dump: local_date and name, the local time; further ones of a second get -1, -2 ... by `order`."""
    local = F.from_utc_timestamp(F.timestamp_seconds("instant"), tz)
    second = Window.partitionBy(*keys, "instant").orderBy("order")
    n = F.row_number().over(second) - 1
    name = F.concat(F.date_format(local, "HHmmss"), F.when(n > 0, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.lit("")), F.lit(".pb"))
    return polls.select("*", F.to_date(local).alias("local_date"), name.alias("name"))


def write_dumps(rows: DataFrame, path: str, quarantine: str) -> None:
    """Appends payloads (city, feed, local_date, name, content, error) below `path`, by city, date and feed; those with an error go below `quarantine`, with it. It can serve as a stream's foreachBatch."""
    by = ("city", "local_date", "feed")
    rows = checkpointed(rows.select(*by, "name", "content", "error"))
    rows.filter("error IS NULL").drop("error").write.mode("append").partitionBy(*by).parquet(path)
    rows.filter("error IS NOT NULL").write.mode("append").partitionBy(*by).parquet(quarantine)


def latest_archive(spark: SparkSession, folder: str, pattern: str = r"\.(zip|tgz|tar\.gz)$") -> str | None:
    """The path of the archive below `folder` whose file name comes last; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").filter(F.col("path").rlike(pattern))
    return files.agg(F.max_by("path", F.substring_index("path", "/", -1))).first()[0]


def md5_of_file(text: Column) -> Column:
    """The md5 that an md5sum file's text names, lower case; empty if it names none."""
    return F.regexp_extract(F.lower(text), r"^\s*([0-9a-f]{32})\b", 1)
