"""Adapters from supplied tables to the common event schema, with their goal vocabularies.

Fixture A reads ``orders`` as an organization event log, fixture B reads ``events``.  Both
are plain projections, so Catalyst prunes every other column at the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.functions.goals import DETAIL, EVENT_ID, NAME, ORG, TS, GoalSpec
from orgpulse.sources.tables import read_table


def orders_as_events(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias(EVENT_ID),
        F.col("o_custkey").cast("string").alias(ORG),
        F.col("o_orderpriority").alias(NAME),
        F.col("o_orderstatus").alias(DETAIL),
        F.col("o_orderdate").cast("timestamp_ntz").alias(TS),
    )


def stream_as_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias(EVENT_ID),
        F.col("user_id").cast("string").alias(ORG),
        F.col("event_type").alias(NAME),
        F.get_json_object(F.col("props"), "$.k").alias(DETAIL),
        F.col("ts").cast("timestamp_ntz").alias(TS),
    )


def fixture_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as_events(read_table(spark, sf_dir, "orders"))


def fixture_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_as_events(read_table(spark, sf_dir, "events"))


# Goal vocabulary for fixture A (order priorities as activities, order status as detail).
ORDER_GOALS: tuple[GoalSpec, ...] = (
    GoalSpec("urgent", "Urgent Orders", "1-URGENT", None, 2),
    GoalSpec("high", "High Orders", "2-HIGH", None, 1),
    GoalSpec("medium", "Medium Orders", "3-MEDIUM", None, 1),
    GoalSpec("low", "Low Orders", "5-LOW", None, 1),
    GoalSpec("unspecified", "Unspecified Orders", "4-NOT SPECIFIED", ("F", "O"), 2),
)


def _numbers(n: int) -> tuple[str, ...]:
    return tuple(str(i) for i in range(n))


# Goal vocabulary for fixture B (event types as activities, the JSON key ``k`` as detail).
STREAM_GOALS: tuple[GoalSpec, ...] = (
    GoalSpec("signup", "Signup", "signup", _numbers(20), 2),
    GoalSpec("click", "Click", "click", _numbers(20), 2),
    GoalSpec("purchase", "Purchase", "purchase", _numbers(20), 1),
    GoalSpec("error", "Error", "error", _numbers(20), 1),
    GoalSpec("view", "View", "view", _numbers(12), 2),
)
