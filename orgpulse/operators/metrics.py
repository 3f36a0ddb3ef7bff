"""Headline metrics (M4–M8, M11).  Each returns a small DataFrame; all but feature
engagement read the per-organization profile, so they cost one partial aggregation of the
events plus a global aggregate over organizations.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.functions.goals import DETAIL, ORG, GoalSpec, all_met
from orgpulse.functions.stats import ratio, ratio_or_zero
from orgpulse.functions.timefns import SECONDS_PER_DAY, days_between, seconds_between
from orgpulse.operators.common import unpivot_structs
from orgpulse.operators.goals import FIRST, LAST, flag_columns


def _flagged(profile: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    return profile.select("*", *flag_columns(goals))


def activation_rate(profile: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """M4: activated organizations / distinct organizations, 0 when there are none."""
    agg = _flagged(profile, goals).agg(
        F.count_if(all_met(goals)).alias("activated_orgs"),
        F.count(F.col(ORG)).alias("total_orgs"))
    return agg.select("activated_orgs", "total_orgs",
                      ratio_or_zero("activated_orgs", "total_orgs").alias("activation_rate"))


def activated_span_days(profile: DataFrame, goals: Sequence[GoalSpec],
                        activated: DataFrame | None = None) -> DataFrame:
    """M5: average days between first and last event over activated organizations, 0 if none.

    This is the reference's "time to activation" (T1); the time of the event that completes
    activation is :func:`orgpulse.operators.journey.activation_times`.  By default the
    activated set comes from the same profile (no join).  Given a separately stored activation
    mart, ``activated``, it is applied as a left semi-join (J4, ``IN (SELECT …)``).
    """
    if activated is not None:
        act = profile.join(activated.select(ORG).distinct(), ORG, "left_semi")
    else:
        act = _flagged(profile, goals).filter(all_met(goals))
    return act.agg(F.count(F.lit(1)).alias("activated_orgs"),
                   F.coalesce(F.avg(days_between(F.col(FIRST), F.col(LAST))), F.lit(0.0))
                   .alias("avg_days"))


def goal_completion_rates(profile: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """M6: per goal, organizations with the flag / all organizations (NULL without rows)."""
    flagged = _flagged(profile, goals)
    wide = flagged.agg(F.count(F.lit(1)).alias("_n"),
                       *[F.sum(g.column).cast("bigint").alias(g.column) for g in goals])
    rows = [F.struct(F.lit(g.name).alias("goal"), F.lit(g.label).alias("label"),
                     F.col(g.column).alias("completed_orgs"), F.col("_n").alias("total_orgs"),
                     ratio(g.column, "_n").alias("rate")) for g in goals]
    return unpivot_structs(wide, rows)


def feature_engagement(events: DataFrame, goal: GoalSpec) -> DataFrame:
    """M7: per detail of ``goal``, distinct organizations with a matching event over all
    organizations.  Details nobody viewed are absent (T8)."""
    engaged = (events.filter(goal.predicate()).groupBy(DETAIL)
               .agg(F.count_distinct(ORG).alias("engaged_orgs")))
    total = events.agg(F.count_distinct(ORG).alias("total_orgs"))  # one row: proven bound
    return (engaged.crossJoin(F.broadcast(total))
            .select(F.col(DETAIL), "engaged_orgs", "total_orgs",
                    ratio("engaged_orgs", "total_orgs").alias("rate")))


def goal_times(profile: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """M8: per goal, average days to the first matching event over organizations that reach
    the goal's minimum count; NULL when none does."""
    aggs = []
    for g in goals:
        secs = seconds_between(F.col(FIRST), F.col(g.first_ts_column))
        reached = F.col(g.count_column) >= g.min_count
        aggs += [F.count_if(reached).alias(f"_r_{g.name}"),
                 (F.avg(F.when(reached, secs)) / F.lit(SECONDS_PER_DAY)).alias(f"_d_{g.name}")]
    wide = profile.agg(*aggs)
    rows = [F.struct(F.lit(g.name).alias("goal"), F.lit(g.label).alias("label"),
                     F.col(f"_r_{g.name}").alias("orgs_reached"),
                     F.col(f"_d_{g.name}").alias("avg_days")) for g in goals]
    return unpivot_structs(wide, rows)


def goal_reached_within_days(profile: DataFrame, goals: Sequence[GoalSpec], days: float) -> DataFrame:
    """Per goal, share of organizations that reached it and whose first matching event
    came within ``days`` of their first event (0 when there are no organizations)."""
    limit = F.lit(float(days) * SECONDS_PER_DAY)
    aggs = []
    for g in goals:
        hit = (F.col(g.count_column) >= g.min_count) & \
              (seconds_between(F.col(FIRST), F.col(g.first_ts_column)) <= limit)
        aggs.append(F.avg(F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))).alias(f"_p_{g.name}"))
    wide = profile.agg(*aggs)
    rows = [F.struct(F.lit(g.name).alias("goal"), F.lit(g.label).alias("label"),
                     F.lit(float(days)).alias("days"),
                     F.coalesce(F.col(f"_p_{g.name}"), F.lit(0.0)).alias("probability"))
            for g in goals]
    return unpivot_structs(wide, rows)
