"""Service times are seconds since noon minus twelve hours and may exceed a day; service dates are dates; instants are epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def parse_time(text: Column) -> Column:
    """Seconds of `H:MM:SS`, hours beyond 23 included; blank and null give null, anything else is an error."""
    t = F.trim(text)
    m = F.regexp_extract_all(t, F.lit(r"^(\d+):([0-5]\d):([0-5]\d)$"), F.lit(0))
    p = F.split(t, ":")
    seconds = p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("int")).when(F.size(m) == 1, seconds).otherwise(F.raise_error(F.concat(F.lit("malformed time: "), t)).cast("int"))


def parse_date(day: Column) -> Column:
    """The date of a yyyymmdd number or text; malformed values are an error."""
    return F.to_date(F.lpad(day.cast("string"), 8, "0"), "yyyyMMdd")


def service_instant(day: Column, seconds: Column, tz: Column | str) -> Column:
    """Epoch seconds of a service time: local noon of the service date, less twelve hours, plus the seconds. Right on days when clocks change."""
    tz = F.lit(tz) if isinstance(tz, str) else tz
    noon = F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(12), F.lit(0), F.lit(0), tz)
    return F.unix_seconds(noon) - 43200 + seconds


def calendar_day(day: Column, seconds: Column) -> Column:
    """The calendar date on which a service time falls."""
    return F.date_add(day, F.floor(seconds / DAY).cast("int"))


def past_midnight(seconds: Column) -> Column:
    return F.coalesce(seconds >= DAY, F.lit(False))


def epoch(ts: Column) -> Column:
    """Epoch seconds of a timestamp without time zone, taken as UTC."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def local_hour(instant: Column, tz: str) -> Column:
    return F.hour(F.from_utc_timestamp(F.timestamp_seconds(instant), tz))


def is_rollover(delay: Column, tolerance: int = 3600) -> Column:
    """Delays of a day, early or late, within the tolerance: a service date taken for its neighbour."""
    return (F.abs(F.abs(delay) - DAY)) <= tolerance


#: Upper bounds of the lead-time bands in minutes; a band is (lower, upper].
LEAD_BANDS = (0, 5, 15, 30, 60, 120)


def lead_band(lead_s: Column) -> Column:
    """Number of the band that holds a lead time: 0 up to zero, then one for each bound, and one beyond."""
    out = F.lit(len(LEAD_BANDS))
    for k in range(len(LEAD_BANDS) - 1, -1, -1):
        out = F.when(lead_s <= LEAD_BANDS[k] * 60, k).otherwise(out)
    return F.when(lead_s.isNotNull(), out)


def five_minutes(seconds: Column) -> Column:
    """Minutes, rounded half to even to a multiple of five."""
    return (F.bround(seconds / 300.0) * 5).cast("int")
