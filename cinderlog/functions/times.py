"""RFC 3339 parsing and formatting, local times and preset windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from cinderlog.fixed import PRESET_DEFAULT, PRESET_MINUTES, RFC3339


def parse_rfc3339(text: Column) -> Column:
    """Timestamp, or null where ``text`` is not a valid RFC 3339 date-time."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def format_rfc3339(ts: Column) -> Column:
    """UTC text with trailing zeros of the fraction left out."""
    fraction = F.regexp_replace(F.date_format(ts, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def ntz(value: dt.datetime | str) -> Column:
    """Zone-less timestamp literal; aware values are turned to UTC first."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def local_as_utc(wall: str, zone: str) -> Column:
    """UTC bound of a local wall time.

    Only the literal is converted, so the column side stays bare and the
    comparison still reaches the scan.
    """
    return F.to_utc_timestamp(F.lit(wall).cast("timestamp"), zone).cast("timestamp_ntz")


def preset_window(as_of: dt.datetime, preset: str = PRESET_DEFAULT) -> tuple[dt.datetime, dt.datetime]:
    """Start and end of a named look-back window ending at ``as_of``."""
    return as_of - dt.timedelta(minutes=PRESET_MINUTES[preset]), as_of
