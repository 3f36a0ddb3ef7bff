"""Per-organization goal aggregate (A5, A6, A8) and the goal / activation marts (M2, M3).

:func:`org_goal_profile` is the one aggregate the marts and most metrics derive from:
per organization the first and last event, the event count, and per goal the progress
count (rows or distinct details) and the time of the first matching event.  It is a single
``groupBy`` with partial (map-side) aggregation: one scan, one shuffle of partial rows.
Time since first activity is derived from it, which equals the minimum over the staged
events because whole-second truncation is monotone (T3: first, not k-th, occurrence).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.functions.goals import ORG, TS, GoalSpec, all_met, goal_names
from orgpulse.functions.timefns import days_between, seconds_between

FIRST = "first_ts"
LAST = "last_ts"
N_EVENTS = "n_events"


def profile_aggregates(goals: Sequence[GoalSpec]) -> list:
    goal_names(goals)
    aggs = [F.min(TS).alias(FIRST), F.max(TS).alias(LAST), F.count(F.lit(1)).alias(N_EVENTS)]
    for g in goals:
        aggs.append(g.progress_column().alias(g.count_column))
        aggs.append(F.min(F.when(g.predicate(), F.col(TS))).alias(g.first_ts_column))
    return aggs


def org_goal_profile(events: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    return events.groupBy(ORG).agg(*profile_aggregates(goals))


def flag_columns(goals: Sequence[GoalSpec]) -> list:
    return [(F.col(g.count_column) >= g.min_count).cast("int").alias(g.column) for g in goals]


def goal_flags(profile: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """M2: one row per organization, a 0/1 column per goal."""
    return profile.select(F.col(ORG), *flag_columns(goals))


def fully_activated(flags: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """M3: organizations whose every goal flag is 1."""
    return flags.filter(all_met(goals)).select(ORG)


def goal_counts(profile: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """A5: progress count per goal and organization."""
    return profile.select(F.col(ORG), *[F.col(g.count_column).cast("bigint") for g in goals])


def first_seconds_columns(goals: Sequence[GoalSpec]) -> list:
    return [seconds_between(F.col(FIRST), F.col(g.first_ts_column)).alias(g.first_seconds_column)
            for g in goals]


def goal_first_seconds(profile: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """Seconds from an organization's first event to its first event of each goal
    (NULL when it has none)."""
    return profile.select(F.col(ORG), *first_seconds_columns(goals))


def org_activity_span(profile: DataFrame) -> DataFrame:
    """First and last event per organization and the span in days."""
    return profile.select(F.col(ORG), F.col(FIRST).alias("first_event"),
                          F.col(LAST).alias("last_event"),
                          days_between(F.col(FIRST), F.col(LAST)).alias("span_days"))
