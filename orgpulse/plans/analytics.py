"""User-level API: the analytics an organization-goal report asks for, over one event log.

:class:`GoalAnalytics` persists the per-organization goal profile once; every metric is then
a small aggregate over it, so asking for all of them costs one scan of the events.  Methods
return DataFrames; the ``*_dict`` helpers collect a final, few-row result for printing.
"""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from orgpulse.functions.goals import REFERENCE_GOALS, GoalSpec
from orgpulse.operators import classify, features, goals as G, journey, metrics, profile, survival


class GoalAnalytics:
    def __init__(self, events: DataFrame, goals: Sequence[GoalSpec] = REFERENCE_GOALS):
        self.events = events
        self.goals = tuple(goals)
        self._profile: DataFrame | None = None

    # -- shared aggregate ---------------------------------------------------------------
    @property
    def profile(self) -> DataFrame:
        if self._profile is None:
            self._profile = G.org_goal_profile(self.events, self.goals).persist(StorageLevel.MEMORY_AND_DISK)
        return self._profile

    def unpersist(self) -> None:
        if self._profile is not None:
            self._profile.unpersist()
            self._profile = None

    # -- marts --------------------------------------------------------------------------
    def goal_flags(self) -> DataFrame:
        return G.goal_flags(self.profile, self.goals)

    def fully_activated(self) -> DataFrame:
        return G.fully_activated(self.goal_flags(), self.goals)

    # -- headline metrics ---------------------------------------------------------------
    def trial_activation_rate(self) -> DataFrame:
        return metrics.activation_rate(self.profile, self.goals)

    def time_to_activation(self) -> DataFrame:
        """Average first-to-last-event span of activated organizations (days)."""
        return metrics.activated_span_days(self.profile, self.goals)

    def goal_completion_rates(self) -> DataFrame:
        return metrics.goal_completion_rates(self.profile, self.goals)

    def feature_engagement_rates(self, goal: GoalSpec | None = None) -> DataFrame:
        """Per detail of ``goal`` (default: the last goal with a detail list)."""
        if goal is None:
            with_details = [g for g in self.goals if g.details]
            if not with_details:
                raise ValueError("no goal has a detail list; pass the goal to report on")
            goal = with_details[-1]
        return metrics.feature_engagement(self.events, goal)

    def goal_achievement_times(self) -> DataFrame:
        return metrics.goal_times(self.profile, self.goals)

    advanced_features_rate = feature_engagement_rates

    def goal_achievement_probability(self, *args) -> DataFrame:
        """``(days)`` for every goal, or ``(goal, days)`` for one goal given by its short name
        or its mart column (``goal_<name>``): the share of organizations that reached the goal
        within ``days`` of their first event."""
        if len(args) == 1:
            goal, days = None, args[0]
        elif len(args) == 2:
            goal, days = args
        else:
            raise TypeError("goal_achievement_probability(days) or (goal, days)")
        out = metrics.goal_reached_within_days(self.profile, self.goals, days)
        if goal is None:
            return out
        names = {g.name: g.name for g in self.goals} | {g.column: g.name for g in self.goals}
        if goal not in names:
            raise ValueError(f"unknown goal {goal!r}")
        return out.filter(out["goal"] == names[goal])

    # -- journeys and survival ----------------------------------------------------------
    def completing_events(self) -> DataFrame:
        return journey.completing_events(self.events, self.goals)

    def activation_times(self) -> DataFrame:
        return journey.activation_times(self.events, self.goals)

    def time_to_goal(self) -> DataFrame:
        return journey.time_to_goal(self.events, self.goals)

    def survival_curves(self, with_band: bool = True) -> DataFrame:
        durations = self.time_to_goal()
        if with_band:
            return survival.km_band(durations, journey.GOAL, "days")
        return survival.km_curve(durations, journey.GOAL, "days")

    # -- profiling ----------------------------------------------------------------------
    def goal_correlation(self) -> DataFrame:
        return profile.correlation_matrix(self.goal_flags(), [g.column for g in self.goals])

    # -- model --------------------------------------------------------------------------
    def classifier(self, target: GoalSpec | None = None, test_percent: int = 20, seed: int = 42):
        """Features → split → standardise → logistic regression; returns (predictions, report)."""
        target = target or self.goals[0]
        feats = features.org_features(self.events, self.goals)
        split = features.train_test_split(features.feature_matrix(feats, target.column), test_percent, seed)
        preds = classify.train_and_predict(features.standardize(split))
        return preds, classify.classification_report(preds)

    # -- small results for printing -----------------------------------------------------
    @staticmethod
    def as_dict(df: DataFrame, key: str, value: str) -> dict:
        """Collect a final few-row result (one row per goal / detail) as ``{key: value}``."""
        return {r[key]: r[value] for r in df.collect()}

    def report(self) -> dict:
        rate = self.trial_activation_rate().first()
        span = self.time_to_activation().first()
        engagement = (self.as_dict(self.feature_engagement_rates(), "activity_detail", "rate")
                      if any(g.details for g in self.goals) else {})
        return {
            "activation_rate": rate.activation_rate,
            "time_to_activation_days": span.avg_days,
            "goal_completion_rates": self.as_dict(self.goal_completion_rates(), "label", "rate"),
            "feature_engagement_rates": engagement,
            "goal_achievement_days": self.as_dict(self.goal_achievement_times(), "label", "avg_days"),
        }


def main(argv: list[str] | None = None, spark=None) -> int:
    """Print the report of a staged or raw event table written as parquet: section, name and value.

        python -m orgpulse.plans.analytics --events /shared/marts/raw
    """
    import argparse

    from orgpulse.session import build_session

    ap = argparse.ArgumentParser(description=main.__doc__)
    ap.add_argument("--events", required=True, help="parquet folder with the event schema")
    args = ap.parse_args(argv)
    own = spark is None
    spark = spark or build_session()
    ga = GoalAnalytics(spark.read.parquet(args.events))
    for section, values in ga.report().items():
        for name, value in (values.items() if isinstance(values, dict) else [("", values)]):
            print(f"{section}\t{name}\t{'' if value is None else format(value, '.6g')}")
    ga.unpersist()
    if own:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
