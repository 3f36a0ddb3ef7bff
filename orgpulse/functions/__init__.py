"""Column-level building blocks: goal predicates, time arithmetic, guarded statistics."""

from orgpulse.functions.goals import (  # noqa: F401
    DETAIL, EVENT_COLUMNS, EVENT_ID, NAME, ORG, TS, GoalSpec, REFERENCE_GOALS, all_met, goals_from_json,
    goals_from_records, with_distinct_detail_goals,
)
from orgpulse.functions.stats import pearson_from_moments, ratio, ratio_or_zero  # noqa: F401
from orgpulse.functions.timefns import (  # noqa: F401
    day_of_week, days_between, epoch_seconds, hour_of_day, seconds_between, seconds_to_days,
)
