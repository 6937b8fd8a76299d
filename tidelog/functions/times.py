"""Timestamps, days and daily index names.  Everything is UTC."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and patterns (fixed values).
_RFC3339 = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)"
RFC3339 = rf"\A{_RFC3339}\z"
INDEX_PREFIX = "logs-v1-"
INDEX_NAME = r"\Alogs-v1-(\d{4})\.(\d{2})\.(\d{2})\z"
INDEX_DAY_FORMAT = "yyyy.MM.dd"


def parse_rfc3339(col: Column) -> Column:
    """Strict RFC 3339 with a mandatory offset; NULL for anything else.

    Offsets up to 23:59 count; a cast knows those up to 18:00 only, so a wider one
    is taken off the local time here.
    """
    text = F.replace(col, F.lit(","), F.lit("."))
    wide = col.rlike(r"[+-](1[89]|2\d):\d\d\z")
    local = F.regexp_replace(text, r"[+-]\d\d:\d\d\z", "Z").try_cast("timestamp")
    sign = F.when(F.substring(col, -6, 1) == "-", -1).otherwise(1)
    minutes = 60 * F.substring(col, -5, 2).try_cast("int") + F.substring(col, -2, 2).try_cast("int")
    shifted = F.timestamp_micros(F.unix_micros(local) - (sign * minutes).cast("long") * 60_000_000)
    return F.when(col.rlike(RFC3339), F.when(wide, shifted).otherwise(text.try_cast("timestamp")))


def format_rfc3339(col: Column) -> Column:
    """RFC 3339 with microseconds; trailing zeros of the fraction are dropped."""
    text = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0{1,6}$", ""), F.lit("Z"))


def format_rfc3339_seconds(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_day(event_ts: Column, ingested_at: Column) -> Column:
    """The day a document belongs to: event day, or arrival day without one."""
    return F.to_date(F.coalesce(event_ts, ingested_at))


def index_name(day: Column) -> Column:
    return F.concat(F.lit(INDEX_PREFIX), F.date_format(day, INDEX_DAY_FORMAT))


def index_day(name: Column) -> Column:
    """The day of a well-formed index name with a real calendar date, or NULL."""
    digits = F.regexp_replace(F.substring(name, len(INDEX_PREFIX) + 1, 10), r"\.", "-")
    return F.when(name.rlike(INDEX_NAME), digits.try_cast("date"))


def as_timestamp(moment: Column | str | dt.datetime) -> Column:
    """An ``as_of`` argument: a Column, an RFC 3339 text or an aware datetime."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, str):
        moment = parse_moment(moment)
    if moment.tzinfo is None:
        raise ValueError("as_of needs an offset")
    text = moment.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return F.lit(text).cast("timestamp")


def parse_moment(text: str) -> dt.datetime:
    """An RFC 3339 request argument as an aware datetime; ValueError if it is not one."""
    if not re.fullmatch(_RFC3339, text):
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    head, frac, zone = re.match(r"^(.{19})([.,]\d+)?(.+)$", text).groups()
    frac = ((frac or ".0")[1:] + "000000")[:6]
    return dt.datetime.fromisoformat(f"{head}.{frac}{'+00:00' if zone == 'Z' else zone}")
