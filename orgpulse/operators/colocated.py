"""Checks and metrics by organization on tables laid out by it (:mod:`orgpulse.sources.layout`): V5, V11 and J4.

Events are grouped and joined by (organization, salt) bucket by bucket.  Only results of one row per
organization are shuffled, above the join, to bring the salts of large organizations together.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions.goals import DETAIL, ORG, TS, GoalSpec
from orgpulse.functions.timefns import days_between
from orgpulse.operators.goals import FIRST, LAST
from orgpulse.operators.quality import coverage_rows, total_rows
from orgpulse.sources.layout import KEYS, plain
from orgpulse.sources.tables import TableSet


def _same_bucket(events: DataFrame, orgs: DataFrame, how: str) -> DataFrame:
    """Join by (organization, salt).  The merge join needs no shuffle and no bound on either side."""
    return events.join(orgs.hint("merge"), list(KEYS), how)


def check_org_coverage(tables: TableSet) -> DataFrame:
    """V5 on the tables ``events`` and ``goals``."""
    return coverage_rows(coverage(tables.table("events"), tables.table("goals")))


def check_goal_totals(tables: TableSet, goals: Sequence[GoalSpec]) -> DataFrame:
    """V11 on the tables ``events`` and ``goals``."""
    recounted = goal_totals(tables.table("events"), goals).withColumnsRenamed({g.column: f"r_{g.name}" for g in goals})
    mart = plain(tables.table("goals")).agg(*[F.sum(g.column).alias(f"m_{g.name}") for g in goals])
    return total_rows(recounted, mart, goals)


def coverage(events: DataFrame, orgs: DataFrame) -> DataFrame:
    """V5: organizations of ``events``, and how many of them ``orgs`` has: staging_orgs, goal_orgs."""
    seen = events.select(*KEYS).distinct()
    joined = _same_bucket(seen, orgs.select(*KEYS, F.lit(1).alias("_found")), "left")
    per_org = joined.where(F.col(ORG).isNotNull()).groupBy(ORG).agg(F.max("_found").alias("_found"))
    return per_org.agg(F.count(F.lit(1)).alias("staging_orgs"), F.count("_found").alias("goal_orgs"))


def goal_totals(events: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """Per goal (columns named like the flags) the organizations that reach it, recounted from the events."""
    parts: list[Column] = []
    whole: list[Column] = []
    for g in goals:
        if g.distinct_details:
            names = [f"_{g.name}_{k}" for k in range(len(set(g.details)))]
            parts += [F.max(F.when(g.predicate() & (F.col(DETAIL) == d), 1).otherwise(0)).alias(n)
                      for n, d in zip(names, sorted(set(g.details)))]
            found = reduce(lambda a, b: a + b, [F.max(n) for n in names])
        else:
            parts.append(F.count_if(g.predicate()).alias(f"_{g.name}"))
            found = F.sum(f"_{g.name}")
        whole.append((found >= g.min_count).cast("int").alias(g.column))
    per_org = events.groupBy(*KEYS).agg(*parts).groupBy(ORG).agg(*whole)
    return per_org.agg(*[F.sum(g.column).alias(g.column) for g in goals])


def activated_span_days(events: DataFrame, activated: DataFrame) -> DataFrame:
    """M5 through J4: average days from first to last event of the organizations in ``activated``."""
    spans = events.groupBy(*KEYS).agg(F.min(TS).alias(FIRST), F.max(TS).alias(LAST))
    per_org = _same_bucket(spans, activated.select(*KEYS), "left_semi").groupBy(ORG).agg(
        F.min(FIRST).alias(FIRST), F.max(LAST).alias(LAST))
    return per_org.agg(F.count(F.lit(1)).alias("activated_orgs"),
                       F.coalesce(F.avg(days_between(F.col(FIRST), F.col(LAST))), F.lit(0.0)).alias("avg_days"))
