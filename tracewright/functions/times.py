"""Timestamp texts. The text is what is hashed, so it stays text at rest.

Texts in canonical form sort like the instants they name, so ordered checks
compare the text; arithmetic uses timestamp_ntz, which no session time zone
can shift.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracewright.config import TIME_PATTERN

_RFC3339 = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def format_time(ts: Column) -> Column:
    """Canonical text of a timestamp_ntz that holds UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_time(text: Column) -> Column:
    """timestamp_ntz of a text already in canonical form, else null."""
    return F.when(text.rlike(TIME_PATTERN), F.substring(text, 1, 26).try_cast("timestamp_ntz"))


def canonical_time_ok(text: Column) -> Column:
    return parse_time(text).isNotNull()


def normalize_occurred_at(text: Column) -> Column:
    """RFC 3339 with any offset -> canonical UTC text cut to microseconds; null if unusable."""
    base = F.regexp_extract(text, _RFC3339, 1)
    micros = F.rpad(F.substring(F.regexp_extract(text, _RFC3339, 2), 2, 6), 6, "0")
    zone = F.regexp_extract(text, _RFC3339, 3)
    local = F.concat(base, F.lit("."), micros).try_cast("timestamp_ntz")
    sign = F.when(F.substring(zone, 1, 1) == "-", F.lit(1)).otherwise(F.lit(-1))
    hours = F.substring(zone, 2, 2).try_cast("int")
    minutes = F.substring(zone, 5, 2).try_cast("int")
    shift = F.when(zone == "Z", F.lit(0)).otherwise(sign * (hours * 60 + minutes))
    year = F.substring(text, 1, 4).try_cast("int")
    usable = text.rlike(_RFC3339) & (year >= 1970) & ((zone == "Z") | ((hours <= 24) & (minutes < 60)))
    return F.when(usable, format_time(local + F.make_dt_interval(mins=shift)))


def window_bound(text: Column) -> Column:
    """A listing bound: RFC 3339, or a date meaning UTC midnight."""
    date = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text.try_cast("date"))
    return F.coalesce(normalize_occurred_at(text),
                      F.when(date.isNotNull(), F.concat(text, F.lit("T00:00:00.000000Z"))))
