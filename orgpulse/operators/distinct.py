"""Exact distinct counts that merge (A2, A4, M7): bitmaps over dense member numbers.

A count of distinct organizations can't be added up: the organizations of two days overlap.  The states here can.
Members get dense numbers once (S6); a state holds, per group and block of 32,768 numbers, a bitmap of 4 KB with
one bit per member seen.  Bits are set map-side, so what is shuffled is a bitmap per (group, block) and task, whatever
the number of events and of (group, member) pairs; states of days, months or tables are merged by OR, and a count is the
number of bits.  Nothing is approximate.

Members already numbered keep their numbers when later events bring new ones (:func:`extend_numbers`), so stored
states stay valid; :func:`add_events` keeps numbers and states together as one version of a
:class:`~orgpulse.sources.versions.VersionedTables`.

NULL members are not counted (as in ``count(DISTINCT …)``); a NULL in a group column is a group.  A group whose
members are all NULL has no state.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions.goals import DETAIL, ORG, TS, GoalSpec
from orgpulse.functions.stats import ratio
from orgpulse.operators.common import broadcast_if_small, consecutive_ids, holding
from orgpulse.session import materialize
from orgpulse.sources.versions import Build, VersionedTables

NUMBER, BLOCK, BITS = "member_number", "block", "bits"


def number_members(events: DataFrame, member: str = ORG, start: int = 1) -> DataFrame:
    """``member`` → ``member_number``: 1, 2, … in the order of the members; NULL has none."""
    members = events.select(member).where(F.col(member).isNotNull()).distinct()
    return consecutive_ids(members, [member], NUMBER, start)


def extend_numbers(numbers: DataFrame, events: DataFrame, member: str = ORG) -> DataFrame:
    """``numbers`` and, after the highest of them, numbers for the members of ``events`` that have none."""
    highest = numbers.agg(F.max(NUMBER)).first()[0] or 0
    new = events.select(member).join(numbers.select(member), member, "left_anti")
    return numbers.unionByName(number_members(new, member, highest + 1))


def numbered(events: DataFrame, numbers: DataFrame, member: str = ORG) -> DataFrame:
    """``events`` with the number of their member; rows with a NULL member go.  The numbers are broadcast under the
    measured bound only; above it the join is a shuffle join that AQE may split at a hot member."""
    side, _ = broadcast_if_small(numbers.select(member, NUMBER))
    return holding(events.join(side, member), side)


def distinct_state(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """State of numbered ``events``: ``by``, block, bits."""
    return events.groupBy(*by, F.bitmap_bucket_number(NUMBER).alias(BLOCK)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(NUMBER)).alias(BITS))


def merged(*states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state of several, or a coarser one: per ``by`` and block, the members of any of the states."""
    return reduce(DataFrame.unionByName, [s.select(*by, BLOCK, BITS) for s in states]).groupBy(*by, BLOCK).agg(
        F.bitmap_or_agg(BITS).alias(BITS))


def distinct_counts(state: DataFrame, by: Sequence[str], name: str = "members") -> DataFrame:
    """Members per ``by`` of a state that has one row per ``by`` and block."""
    return state.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).cast("bigint").alias(name))


def add_events(store: VersionedTables, events: DataFrame, by: Sequence[str], member: str = ORG) -> DataFrame:
    """Merge ``events`` into the states stored under ``store`` and return the new state.  Numbers and states are
    published at once; a failure leaves the earlier version, and readers see either.  Only the new events are read.
    An event added twice changes nothing (a bit is set or not)."""
    def publish(build: Build, numbers: DataFrame, earlier: list[DataFrame]) -> DataFrame:
        numbers = build.write("numbers", numbers)
        new = distinct_state(numbered(events.select(*by, member), numbers, member), by)
        return build.write("states", merged(*earlier, new, by=by))

    if store.current() is None:
        with store.build() as build:
            return publish(build, number_members(events, member), [])
    with store.read() as before, store.build() as build:
        return publish(build, extend_numbers(before.table("numbers"), events, member), [before.table("states")])


def month_of(ts: Column) -> Column:
    """First day of the month."""
    return F.trunc(ts, "month")


def monthly_engagement(events: DataFrame, goal: GoalSpec) -> tuple[DataFrame, DataFrame]:
    """State per detail of ``goal`` and month of the organizations with a matching event, and the numbers of all
    organizations.  Both are written to the shared folder (fresh tables): coarser counts come from them without the events."""
    matching = events.where(goal.predicate()).select(DETAIL, ORG, month_of(F.col(TS)).alias("month"))
    numbers = materialize(number_members(events), "member-numbers")
    return materialize(distinct_state(numbered(matching, numbers), [DETAIL, "month"]), "engagement-state"), numbers


def engaged_by_month(state: DataFrame) -> DataFrame:
    """Per detail and month the engaged organizations, those of the year up to that month, and those of all months.
    A NULL month is a month of its own."""
    year = lambda c: F.coalesce(F.year(c), F.lit(-1))
    months = state.select(F.col(DETAIL).alias("_detail"), F.col("month").alias("upto")).distinct()
    reached = (F.col(DETAIL).eqNullSafe(F.col("_detail")) & (year("month") == year("upto"))
               & F.coalesce(F.col("month") <= F.col("upto"), F.lit(True)))
    so_far = merged(state.join(months, reached).drop(DETAIL, "month"), by=["_detail", "upto"])
    to_date = distinct_counts(so_far, ["_detail", "upto"], "year_to_date")
    own = distinct_counts(state, [DETAIL, "month"], "engaged_orgs")
    ever = distinct_counts(merged(state, by=[DETAIL]), [DETAIL], "all_months").withColumnRenamed(DETAIL, "_any")
    return (own.join(to_date, F.col(DETAIL).eqNullSafe(F.col("_detail")) & F.col("month").eqNullSafe(F.col("upto")))
            .join(ever, F.col(DETAIL).eqNullSafe(F.col("_any")))
            .select(DETAIL, "month", "engaged_orgs", "year_to_date", "all_months"))


def feature_engagement_from(state: DataFrame, numbers: DataFrame) -> DataFrame:
    """M7 from a state with a detail column: organizations per detail over all numbered organizations."""
    total = numbers.agg(F.count(F.lit(1)).alias("total_orgs"))  # one row: proven bound
    return (distinct_counts(merged(state, by=[DETAIL]), [DETAIL], "engaged_orgs").crossJoin(F.broadcast(total))
            .select(DETAIL, "engaged_orgs", "total_orgs", ratio("engaged_orgs", "total_orgs").alias("rate")))
