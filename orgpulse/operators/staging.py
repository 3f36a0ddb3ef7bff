"""Staging (M1): every event with its organization's first activity and the whole seconds
elapsed since then.

The first activity per organization is an aggregate (map-side partial ``min``), so one
organization holding a third of all rows is combined before the shuffle instead of landing
in a single window task.  It is then joined back: broadcast when the per-organization table
is measured small, otherwise a shuffle join that AQE's skew handling can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgpulse.functions.goals import DETAIL, EVENT_ID, NAME, ORG, TS
from orgpulse.functions.timefns import seconds_between
from orgpulse.operators.common import broadcast_if_small, holding, largest_group, single_task_rows

FIRST_TS = "first_activity_timestamp"
SINCE_FIRST = "time_since_first_activity"
STAGED_COLUMNS = (EVENT_ID, ORG, NAME, DETAIL, TS, FIRST_TS, SINCE_FIRST)


def org_first_activity(events: DataFrame) -> DataFrame:
    return events.groupBy(ORG).agg(F.min(TS).alias(FIRST_TS))


def stage(events: DataFrame, max_broadcast_rows: int | None = None) -> DataFrame:
    firsts, _ = broadcast_if_small(
        org_first_activity(events).withColumnRenamed(ORG, "_org"), max_broadcast_rows)
    # Null-safe key: a NULL organization (null_org="keep") keeps its rows, like the window form.
    joined = events.join(firsts, events[ORG].eqNullSafe(firsts["_org"]), "inner")
    return holding(joined.select(
        F.col(EVENT_ID), F.col(ORG), F.col(NAME), F.col(DETAIL), F.col(TS), F.col(FIRST_TS),
        seconds_between(F.col(FIRST_TS), F.col(TS)).alias(SINCE_FIRST),
    ), firsts)


def stage_window(events: DataFrame) -> DataFrame:
    """Window form of :func:`stage` (W1: ``min(ts) OVER (PARTITION BY organization)``).

    A window partition is one task, so the largest organization is measured first; above the bound
    of :func:`~orgpulse.operators.common.single_task_rows` events this returns :func:`stage`."""
    if largest_group(events, [ORG]) > single_task_rows(events.sparkSession):
        return stage(events)
    first = F.min(TS).over(Window.partitionBy(ORG))
    return events.select(
        EVENT_ID, ORG, NAME, DETAIL, TS, first.alias(FIRST_TS),
        seconds_between(first, F.col(TS)).alias(SINCE_FIRST),
    )
