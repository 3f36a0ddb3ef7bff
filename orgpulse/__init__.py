"""orgpulse — organization goal analytics expressed as Spark DataFrame operators.

An event log ``(event_id, organization_id, activity_name, activity_detail, timestamp)``
is measured against a declarative list of :class:`~orgpulse.functions.goals.GoalSpec`
("at least k events of this kind").  Every operator takes and returns a DataFrame;
nothing but final, few-row results ever reaches the driver.
"""

from orgpulse.functions.goals import GoalSpec, REFERENCE_GOALS, EVENT_COLUMNS

__all__ = ["GoalSpec", "REFERENCE_GOALS", "EVENT_COLUMNS"]
