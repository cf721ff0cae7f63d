"""Time arithmetic on whole microseconds, the same for timestamps with and without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(at: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(at.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds of a gap, cut off toward zero."""
    return ((micros(end) - micros(start)) / 1_000_000).cast("long")


def days_between(start: Column, end: Column) -> Column:
    """Whole days of a gap: a length of time, not a count of midnights."""
    return ((micros(end) - micros(start)) / DAY).cast("long")


def day_number(at: Column) -> Column:
    """Days since the epoch, as an integer that RANGE frames can count on."""
    return F.unix_date(at.cast("date"))


def quarter_label(at: Column) -> Column:
    """YYYY-Qn."""
    return F.concat(F.year(at).cast("string"), F.lit("-Q"), F.quarter(at).cast("string"))


def month_label(at: Column) -> Column:
    """YYYY-MM."""
    return F.date_format(at, "yyyy-MM")
