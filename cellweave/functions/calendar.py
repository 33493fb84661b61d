"""Service days and clock times of timetables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Counted part of the day in seconds since service midnight, half-open
WINDOW_START_S = 7 * 3600
WINDOW_END_S = 19 * 3600


def service_seconds(clock: Column) -> Column:
    """``HH:MM:SS`` with hours beyond 23 to seconds since service midnight; never a timestamp."""
    part = F.split(clock, ":")
    return part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int")


def representative_tuesday(build_date: Column, feed_start: Column) -> Column:
    """First Tuesday strictly after the build date, moved on by whole weeks into the feed's validity."""
    first = F.next_day(build_date, "TU")
    weeks = F.greatest(F.ceil(F.datediff(feed_start, first) / 7), F.lit(0)).cast("int")
    return F.date_add(first, weeks * 7)
