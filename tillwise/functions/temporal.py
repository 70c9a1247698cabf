"""Date helpers for timestamps without a time zone.

Differences are taken as day-time intervals, so the session time zone (and its
daylight-saving jumps) never enters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: Column | dt.date | str) -> Column:
    """A date given as column (for instance a scalar subquery), date or ISO text."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def month_start(ts: Column | str) -> Column:
    return F.trunc(F.col(ts) if isinstance(ts, str) else ts, "month")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds with fraction as decimal(18,6); both sides timestamp_ntz."""
    return (later - earlier).cast("interval second").cast("decimal(18,6)")


def whole_days(later: Column, earlier: Column) -> Column:
    """Days between, floored towards minus infinity (-12 h is -1)."""
    return F.floor(seconds_between(later, earlier) / 86400).cast("int")
