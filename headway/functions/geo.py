"""Plane coordinates in metres, grid cells and walking times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres of a degree of latitude.
DEGREE_M = 111_320.0
#: Walking bands: up to so many metres, so many seconds.
BANDS = ((50, 60), (100, 120), (200, 180), (250, 240))


def project(stops: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon") -> DataFrame:
    """Adds x_m and y_m, whole metres east and north of the mean coordinates; halves are rounded to even."""
    mean = stops.agg(F.avg(lat).alias("lat0"), F.avg(lon).alias("lon0"))
    x = F.bround((F.col(lon) - F.col("lon0")) * F.cos(F.radians("lat0")) * DEGREE_M).cast("long")
    y = F.bround((F.col(lat) - F.col("lat0")) * DEGREE_M).cast("long")
    return stops.join(F.broadcast(mean)).withColumns({"x_m": x, "y_m": y}).drop("lat0", "lon0")  # the means are one row


def cell(metres: Column, side: int) -> Column:
    return F.floor(metres / side).cast("long")


def distance2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def walk_seconds(d2: Column, bands=BANDS) -> Column:
    """The walking time of a squared distance by bands; null beyond the last."""
    out = F.lit(None).cast("int")
    for metres, seconds in reversed(bands):
        out = F.when(d2 <= metres * metres, seconds).otherwise(out)
    return out
