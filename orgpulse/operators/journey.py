"""Journeys: the event at which an organization completes activation (W2, M10, O3) and the
time to each goal (M9).

The reference replays each organization's events one by one and re-tests all goals.  Running
goal counts are monotone, so the completing event is the latest (timestamp, event_id) among
each goal's k-th matching event, for organizations where every goal has one.  The k-th
matching event per (organization, goal) is a ``row_number() <= K`` filter, which Spark turns
into a map-side ``WindowGroupLimit``: each map task forwards at most K rows per group, so a
huge organization never lands whole in one task.  Ties are broken by ``event_id`` (T13).
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgpulse.functions.goals import DETAIL, EVENT_ID, NAME, ORG, TS, GoalSpec, goal_names, \
    with_distinct_detail_goals
from orgpulse.functions.stats import ratio
from orgpulse.functions.timefns import SECONDS_PER_DAY, seconds_between
from orgpulse.operators.common import broadcast_if_small, holding, running_totals
from orgpulse.operators.goals import FIRST, org_goal_profile
from orgpulse.operators.staging import org_first_activity

GOAL = "goal"
COMPLETES = "completes_activation"
COMPLETING_TS = "completing_timestamp"


def _pick(values: list, idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx + F.lit(1))


def goal_reach_events(events: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """Per (organization, goal): the event at which the goal's progress reaches its minimum
    count — the k-th matching event, or with ``distinct_details`` the first event of the k-th
    distinct detail.  Columns: organization_id, goal, event_id, timestamp."""
    goal_names(goals)
    k_max = max(g.min_count for g in goals)

    def matching(ids: list[int]) -> DataFrame:
        # the disjunction lets the scan push the activity filter down; explode keeps one row
        # per (event, goal it matches)
        any_goal = reduce(lambda a, b: a | b, [goals[i].predicate() for i in ids])
        hits = F.array_compact(F.array(*[F.when(goals[i].predicate(), F.lit(i)) for i in ids]))
        return events.filter(any_goal).select(ORG, EVENT_ID, TS, DETAIL, F.explode(hits).alias("_g"))

    plain = [i for i, g in enumerate(goals) if not g.distinct_details]
    distinct = [i for i, g in enumerate(goals) if g.distinct_details]
    parts = []
    if plain:
        parts.append(matching(plain).select(ORG, "_g", TS, EVENT_ID))
    if distinct:
        # first event of each detail (a partial aggregate combines a hot organization map-side)
        firsts = (matching(distinct).groupBy(ORG, "_g", DETAIL)
                  .agg(F.min(F.struct(TS, EVENT_ID)).alias("_e"))
                  .select(ORG, "_g", F.col(f"_e.{TS}").alias(TS), F.col(f"_e.{EVENT_ID}").alias(EVENT_ID)))
        parts.append(firsts)
    matched = reduce(lambda a, b: a.unionByName(b), parts)
    k_of_goal = _pick([g.min_count for g in goals], F.col("_g"))
    limit_threshold = int(events.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k_max <= limit_threshold:
        # row_number() <= K becomes a map-side WindowGroupLimit (K rows per group per task)
        w = Window.partitionBy(ORG, "_g").orderBy(TS, EVENT_ID)
        ranked = matched.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k_max)
        reached = ranked.filter(F.col("_rn") == k_of_goal)
    else:
        # Spark infers no group limit for so large a K: count exactly with the two-level
        # running total, which range-splits a huge (organization, goal) group
        counted = running_totals(matched.withColumn("_one", F.lit(1).cast("bigint")), by=[ORG, "_g"],
                                 order=[TS, EVENT_ID], sums=["_one"])
        reached = counted.filter(F.col("cum__one") == k_of_goal)
    return reached.select(ORG, _pick([g.name for g in goals], F.col("_g")).alias(GOAL), EVENT_ID, TS)


def completion_points(events: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """Per activated organization the event that completes activation:
    organization_id, event_id, completing_timestamp."""
    reach = goal_reach_events(events, goals)
    done = (reach.groupBy(ORG)
            .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(TS, EVENT_ID)).alias("_last"))
            .filter(F.col("_n") == len(goals)))
    return done.select(ORG, F.col(f"_last.{EVENT_ID}").alias(EVENT_ID),
                       F.col(f"_last.{TS}").alias(COMPLETING_TS))


def completing_events(events: DataFrame, goals: Sequence[GoalSpec],
                      max_broadcast_rows: int | None = None) -> DataFrame:
    """Every event with a boolean ``completes_activation`` (true on exactly one event of
    each activated organization)."""
    marks = completion_points(events, goals).select(
        F.col(ORG).alias("_org"), F.col(EVENT_ID).alias("_eid"), F.lit(True).alias("_c"))
    marks, _ = broadcast_if_small(marks, max_broadcast_rows)
    # null-safe on the organization: a NULL organization (null_org="keep") is a group too
    on = events[ORG].eqNullSafe(marks["_org"]) & (events[EVENT_ID] == marks["_eid"])
    return holding(events.join(marks, on, "left")
                   .select(EVENT_ID, ORG, NAME, DETAIL, TS, F.coalesce(F.col("_c"), F.lit(False)).alias(COMPLETES)), marks)


def activation_times(events: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """O3: per activated organization the completing event and the time since its first event
    (whole seconds, and days = seconds / 86400)."""
    points = completion_points(events, goals)
    firsts = org_first_activity(events).select(F.col(ORG).alias("_org"),
                                               F.col("first_activity_timestamp").alias(FIRST))
    secs = seconds_between(F.col(FIRST), F.col(COMPLETING_TS))
    return (points.join(firsts, points[ORG].eqNullSafe(firsts["_org"]))
            .select(ORG, EVENT_ID, COMPLETING_TS, secs.alias("seconds_since_first"),
                    (secs / F.lit(SECONDS_PER_DAY)).alias("days_since_first")))


def completing_event_rate(events: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """Count and percentage of organizations that have a completing event."""
    activated = completion_points(events, goals).agg(F.count(F.lit(1)).alias("activated_orgs"))
    total = events.agg(F.count_distinct(ORG).alias("total_orgs"))
    return (activated.crossJoin(total)  # two one-row frames
            .select("activated_orgs", "total_orgs",
                    (ratio("activated_orgs", "total_orgs") * F.lit(100.0)).alias("percent")))


def time_to_goal(events: DataFrame, goals: Sequence[GoalSpec], distinct_for_details: bool = True,
                 with_label: bool = False) -> DataFrame:
    """M9: per organization and reached goal, days from the first event to the first matching
    event (T3).  With ``distinct_for_details`` goals that have a detail list count distinct
    details, as the survival analysis does (T2).  Long form: organization_id, goal, days, and with
    ``with_label`` the goal's label, by which curves can be grouped."""
    specs = with_distinct_detail_goals(goals) if distinct_for_details else tuple(goals)
    profile = org_goal_profile(events, specs)
    rows = [F.struct(F.lit(g.name).alias(GOAL), F.lit(g.label).alias("label"),
                     (F.col(g.count_column) >= g.min_count).alias("_met"),
                     (seconds_between(F.col(FIRST), F.col(g.first_ts_column)) / F.lit(SECONDS_PER_DAY))
                     .alias("days")) for g in specs]
    return (profile.select(ORG, F.inline(F.array(*rows)))
            .filter(F.col("_met")).drop("_met", *([] if with_label else ["label"])))
