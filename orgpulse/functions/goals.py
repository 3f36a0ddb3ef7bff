"""Goal specifications and their compilation to Spark ``Column`` predicates.

A goal is "at least ``min_count`` events whose activity is ``activity_name`` (and, when
``details`` is given, whose detail is one of them)".  With ``distinct_details`` the count is
over distinct details instead of rows.  The goal list is data: no operator hard-codes it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column names of the common event schema every operator reads.
EVENT_ID = "event_id"
ORG = "organization_id"
NAME = "activity_name"
DETAIL = "activity_detail"
TS = "timestamp"
EVENT_COLUMNS = (EVENT_ID, ORG, NAME, DETAIL, TS)


def repr_sql(value: str) -> str:
    """A SQL string literal for a value without quotes or backslashes."""
    return f"'{value}'"


@dataclass(frozen=True)
class GoalSpec:
    name: str
    label: str
    activity_name: str
    details: tuple[str, ...] | None = None
    min_count: int = 1
    distinct_details: bool = False

    def __post_init__(self):
        if self.min_count < 1:
            raise ValueError(f"goal {self.name}: min_count must be >= 1")
        if self.distinct_details and not self.details:
            raise ValueError(f"goal {self.name}: distinct_details needs a detail list")

    @property
    def column(self) -> str:
        """0/1 flag column in the goals mart."""
        return f"goal_{self.name}"

    @property
    def count_column(self) -> str:
        return f"n_{self.name}"

    @property
    def first_ts_column(self) -> str:
        return f"first_ts_{self.name}"

    @property
    def first_seconds_column(self) -> str:
        return f"first_s_{self.name}"

    def predicate(self) -> Column:
        """Row predicate; an empty detail list means "no detail filter".

        Compiled as one SQL expression (a single call into the JVM, where a Column built
        value by value costs one call per literal); values holding a quote or backslash are
        built as Columns instead, so no escaping rule is involved."""
        values = (self.activity_name,) + tuple(self.details or ())
        if not any(("'" in v) or ("\\" in v) for v in values):
            sql = f"`{NAME}` = {repr_sql(self.activity_name)}"
            if self.details:
                sql += f" AND `{DETAIL}` IN ({', '.join(repr_sql(d) for d in self.details)})"
            return F.expr(f"({sql})")
        pred = F.col(NAME) == F.lit(self.activity_name)
        if self.details:
            pred = pred & F.col(DETAIL).isin(list(self.details))
        return pred

    def progress_column(self) -> Column:
        """Aggregate expression whose value is compared with ``min_count``."""
        if self.distinct_details:
            # the detail list is finite: one plain maximum per listed detail, no distinct aggregate
            return reduce(lambda a, b: a + b, [
                F.max(F.when(self.predicate() & (F.col(DETAIL) == F.lit(d)), 1).otherwise(0)).cast("bigint")
                for d in dict.fromkeys(self.details)])
        return F.count_if(self.predicate())

    def with_distinct_details(self, flag: bool = True) -> "GoalSpec":
        return replace(self, distinct_details=flag)


def goal_names(goals: Sequence[GoalSpec]) -> list[str]:
    if not goals:
        raise ValueError("at least one goal is needed")
    names = [g.name for g in goals]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate goal names: {names}")
    return names


def all_met(goals: Iterable[GoalSpec]) -> Column:
    """Conjunction "every goal flag = 1" (F5)."""
    return reduce(lambda a, b: a & b, [F.col(g.column) == 1 for g in goals])


def with_distinct_detail_goals(goals: Sequence[GoalSpec]) -> tuple[GoalSpec, ...]:
    """Variant where every goal with a detail list counts distinct details."""
    return tuple(g.with_distinct_details(True) if g.details else g for g in goals)


# The reference's goal vocabulary (activity names, detail list, minimum counts)
# and the labels its reports print.
ADVANCED_FEATURE_PAGES = ("revenue", "integrations-overview", "absence-accounts", "availability")
REFERENCE_GOALS: tuple[GoalSpec, ...] = (
    GoalSpec("shift_created", "Shift Created", "Shift.Created", None, 2),
    GoalSpec("employee_invited", "Employee Invited", "Hr.Employee.Invited", None, 1),
    GoalSpec("punched_in", "Punched In", "PunchClock.PunchedIn", None, 1),
    GoalSpec("punch_in_approved", "Punch In Approved", "PunchClock.Approvals.EntryApproved", None, 1),
    GoalSpec("advanced_features", "Advanced Features", "Page.Viewed", ADVANCED_FEATURE_PAGES, 2),
)


def goals_from_records(records: Iterable[dict]) -> tuple[GoalSpec, ...]:
    """Goal vocabulary from plain records, e.g. parsed JSON:
    ``[{"name": "shift_created", "label": "Shift Created", "activity_name": "Shift.Created",
    "min_count": 2}, …]`` (``details`` a list or absent, ``distinct_details`` optional)."""
    goals = tuple(GoalSpec(name=r["name"], label=r.get("label", r["name"]), activity_name=r["activity_name"],
                           details=tuple(r["details"]) if r.get("details") else None,
                           min_count=int(r.get("min_count", 1)),
                           distinct_details=bool(r.get("distinct_details", False))) for r in records)
    goal_names(goals)
    return goals


def goals_from_json(text: str) -> tuple[GoalSpec, ...]:
    import json
    return goals_from_records(json.loads(text))
