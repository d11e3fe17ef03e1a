"""Timestamps under a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ts: Column) -> Column:
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minute_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def as_utc(text: Column) -> Column:
    """ISO text, with Z, an offset or neither (then UTC)."""
    return F.to_timestamp(text)


def window_start(cursor: Column, now: Column) -> Column:
    """Where the next fetch begins: 15 minutes before the cursor, or 7 days before now; never after now."""
    start = F.coalesce(cursor - F.expr("INTERVAL 15 MINUTES"), now - F.expr("INTERVAL 7 DAYS"))
    return F.least(start, now)
