"""Time arithmetic as JVM-side column expressions, independent of the session time zone.

All event times are ``TIMESTAMP_NTZ``; differences are taken in exact microseconds, so no
Julian-day doubles (and their off-by-one truncation) are involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400.0


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(start, end) -> Column:
    """Whole seconds from ``start`` to ``end``, truncated (exact floor for end >= start)."""
    return F.timestamp_diff("SECOND", _col(start), _col(end))


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def days_between(start, end) -> Column:
    """Fractional days between two timestamps (microsecond exact)."""
    return micros_between(start, end) / F.lit(SECONDS_PER_DAY * 1e6)


def seconds_to_days(secs) -> Column:
    return _col(secs) / F.lit(SECONDS_PER_DAY)


def epoch_seconds(ts) -> Column:
    """Timestamp to epoch seconds as a double, without going through a session time zone."""
    return micros_between(_epoch_ntz(), _col(ts)) / F.lit(1e6)


def day_of_week(ts) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(_col(ts))


def hour_of_day(ts) -> Column:
    return F.hour(_col(ts))
