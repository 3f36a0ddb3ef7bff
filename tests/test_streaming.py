"""The streaming refresh of the marts equals the batch build."""

import os

import pytest

from orgpulse.operators import goals as G
from orgpulse.session import scratch_path
from orgpulse.sources.adapters import ORDER_GOALS, fixture_a, orders_as_events
from orgpulse.streaming import refresh_marts

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(f"{SF}/orders.parquet"), reason="test data not present")
def test_stream_refresh_equals_batch(spark):
    out = scratch_path(spark, "stream-test")
    refresh_marts(spark, SF, ORDER_GOALS, out, orders_as_events, file_glob="orders.parquet")
    streamed = spark.read.parquet(f"{out}/goals")
    batch = G.goal_flags(G.org_goal_profile(fixture_a(spark, SF), ORDER_GOALS), ORDER_GOALS)
    assert streamed.count() == batch.count() == 150
    assert streamed.exceptAll(batch).count() == 0
    assert spark.read.parquet(f"{out}/activation").count() == 20
