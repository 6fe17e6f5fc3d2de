"""Timetable feeds: a folder or zip of comma-separated files, read as DataFrames with fixed columns and types.

All problems of a feed are collected and reported in one error.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.times import parse_date, parse_time
from headway.operators.state import shared_dir
from headway.sources.archives import opened

# Fixed values of the format: required columns by file, and optional ones with their defaults.
REQUIRED = {
    "agency": ("agency_name", "agency_url", "agency_timezone"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
    "routes": ("route_id", "route_type"),
    "trips": ("route_id", "service_id", "trip_id"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "transfers": ("from_stop_id", "to_stop_id", "transfer_type"),
}
DEFAULTS = {
    "stops": {"location_type": "0", "parent_station": "", "wheelchair_boarding": "0"},
    "routes": {"route_short_name": "", "route_long_name": ""},
    "trips": {"direction_id": "0", "wheelchair_accessible": "0", "block_id": ""},
    "transfers": {"min_transfer_time": ""},
}
MANDATORY = ("agency", "stops", "routes", "trips", "stop_times")
_FLAGS = ("location_type", "wheelchair_boarding", "direction_id", "wheelchair_accessible", "exception_type", "transfer_type", "route_type", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


class FeedError(ValueError):
    """What is wrong with a feed, all of it."""


@dataclass
class Feed:
    """The tables of a feed; calendar, calendar_dates and transfers may be None."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    tz: str = "Europe/Rome"

    def __getattr__(self, name: str) -> DataFrame | None:
        if name in REQUIRED:
            return self.__dict__.get("tables", {}).get(name)
        raise AttributeError(name)

    def describe(self) -> str:
        """Row counts, one line."""
        return ", ".join(f"{name} {df.count()}" for name, df in sorted(self.tables.items()))


def unpacked(spark: SparkSession, path: str, staging: str | None = None) -> str:
    """The folder of a feed: `path` itself, or where a zip's text files were put.

    That is below `staging`, by default in the folder that driver and executors share. A task copies a file of the zip, a
    piece at a time, so nothing of them goes through the driver, which reads the zip's directory only.
    """
    files, at = opened(path)
    if not files.get_file_info(at).is_file:
        return path
    with files.open_input_file(at) as f:
        if f.read(4) not in (b"PK\3\4", b"PK\5\6"):  # how a zip begins, with files and without
            return path
        f.seek(0)
        names = [n for n in zipfile.ZipFile(f).namelist() if n.endswith(".txt") and not n.startswith("__MACOSX")]
    folder = f"{staging or shared_dir(spark)}/feed-{uuid.uuid4().hex}"

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, at = opened(path)
        target, below = opened(folder)
        for pdf in batches:
            with source.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                target.create_dir(below, recursive=True)
                for name in pdf["name"]:
                    with z.open(name) as member, target.open_output_stream(f"{below}/{name.rpartition('/')[2]}") as out:
                        while piece := member.read(1 << 20):
                            out.write(piece)
            yield pdf

    todo = spark.createDataFrame([(n,) for n in names], "name string")
    todo.repartition(max(1, len(names)), "name").mapInPandas(copy, "name string").count()
    return folder


def find_files(folder: str) -> dict[str, str]:
    """The feed's files by table name, in the folder or one below."""
    files, at = opened(folder)
    infos = [i for i in files.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file and i.path.endswith(".txt")]
    depth = lambda i: i.path.removeprefix(at).strip("/").count("/")
    near = sorted((i for i in infos if depth(i) <= 1), key=lambda i: (-depth(i), i.path))
    found = {i.base_name.removesuffix(".txt"): i.path for i in near}  # those of the folder itself come last and win
    scheme = "" if isinstance(files, fs.LocalFileSystem) else folder[: folder.index(at)]
    return {k: scheme + p for k, p in found.items() if k in REQUIRED}


def _read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; absent values are empty."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns)).na.fill("")


def _typed(name: str, df: DataFrame) -> DataFrame:
    out = {}
    for c in df.columns:
        if c in _FLAGS:
            out[c] = F.coalesce(F.col(c).try_cast("int"), F.lit(0))
        elif c in ("stop_lat", "stop_lon"):
            out[c] = F.col(c).try_cast("double")
        elif c in ("stop_sequence", "min_transfer_time"):
            out[c] = F.col(c).try_cast("int")
        elif c in ("arrival_time", "departure_time"):
            out[c] = parse_time(F.col(c))
        elif c in ("start_date", "end_date", "date"):
            out[c] = parse_date(F.col(c))
    return df.withColumns(out) if out else df


def load_feed(spark: SparkSession, folder: str, tz: str | None = None) -> Feed:
    """Reads and checks a feed's folder. Nothing is scanned before it is used, but headers and the first agency row."""
    files, problems, tables = find_files(folder), [], {}
    problems += [f"{n}.txt is missing" for n in MANDATORY if n not in files]
    if "calendar" not in files and "calendar_dates" not in files:
        problems.append("neither calendar.txt nor calendar_dates.txt is there")
    for name, path in files.items():
        df = _read(spark, path)
        if missing := [c for c in REQUIRED[name] if c not in df.columns]:
            problems.append(f"{name}.txt has no column {', '.join(missing)}")
            continue
        defaults = {c: F.lit(x) for c, x in DEFAULTS.get(name, {}).items() if c not in df.columns}
        tables[name] = _typed(name, df.withColumns(defaults) if defaults else df)
    if problems:
        raise FeedError("; ".join(problems))
    row = tables["agency"].select("agency_timezone").first()
    return Feed(tables, tz or (row and row[0]) or "Europe/Rome")


def physical_stops(stops: DataFrame) -> DataFrame:
    """Places where vehicles stop: location_type 0, with both coordinates."""
    return stops.filter("location_type = 0 AND stop_lat IS NOT NULL AND stop_lon IS NOT NULL")
