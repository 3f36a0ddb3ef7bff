"""Survival operators: censored fixture C2 known answers and invariants."""

import pytest
from pyspark.sql import functions as F

from orgpulse.operators import survival as S

C2 = [(1.0, 1), (2.0, 0), (3.0, 1), (3.0, 1), (4.0, 0)]


@pytest.fixture(params=[0, None], ids=["two-level", "single-task"], autouse=True)
def running_total_path(request, monkeypatch):
    """Run every survival test through both running-total strategies."""
    import orgpulse.operators.common as common
    if request.param is not None:
        monkeypatch.setattr(common, "SINGLE_TASK_ROWS", request.param)


@pytest.fixture(scope="module")
def durations(spark):
    return spark.createDataFrame([("g", t, o) for t, o in C2], "goal string, days double, obs int")


def test_event_table_censored(durations):
    rows = S.event_table(durations, "goal", "days", "obs").orderBy("t").collect()
    assert [(r.t, r.removed, r.observed, r.censored, r.entrance, r.at_risk) for r in rows] == [
        (0.0, 0, 0, 0, 5, 5), (1.0, 1, 1, 0, 0, 5), (2.0, 1, 0, 1, 0, 4), (3.0, 2, 2, 0, 0, 3), (4.0, 1, 0, 1, 0, 1)]


def test_curve_and_band_censored(durations):
    rows = {r.t: r for r in S.km_band(durations, "goal", "days", "obs").collect()}
    assert rows[0.0].survival == 1.0 and rows[0.0].lower is None
    for t, s, lo, hi in [(1.0, 0.8, 0.203809, 0.969180), (2.0, 0.8, 0.203809, 0.969180),
                         (3.0, 0.266667, 0.009677, 0.686136), (4.0, 0.266667, 0.009677, 0.686136)]:
        assert rows[t].survival == pytest.approx(s, abs=1e-6)
        assert rows[t].lower == pytest.approx(lo, abs=1e-6)
        assert rows[t].upper == pytest.approx(hi, abs=1e-6)


def test_uncensored_curve_is_exact_and_ends_at_zero(spark):
    # many groups and distinct times spread over several range partitions
    df = spark.range(0, 3000).select((F.col("id") % 3).cast("string").alias("goal"),
                                     ((F.col("id") * 7919) % 997 / 10.0).alias("days"))
    curve = S.km_curve(df, "goal", "days").collect()
    by_goal = {}
    for r in curve:
        by_goal.setdefault(r.goal, []).append((r.t, r.survival))
    counts = {g: n for g, n in df.groupBy("goal").count().collect()}
    durs = {}
    for r in df.collect():
        durs.setdefault(r.goal, []).append(r.days)
    for g, pts in by_goal.items():
        pts.sort()
        values = [s for _, s in pts]
        assert values == sorted(values, reverse=True)          # non-increasing
        assert values[-1] == 0.0                                 # no censoring: ends at 0
        for t, s in pts:                                         # exact 1 - F(t)
            assert s == (counts[g] - sum(1 for d in durs[g] if d <= t)) / counts[g]


def test_null_group_is_a_group_and_null_durations_fail(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("g", 1.0)], "goal string, days double")
    rows = {(r.goal, r.t): r.survival for r in S.km_curve(df, "goal", "days").collect()}
    assert rows == {(None, 0.0): 1.0, (None, 1.0): 0.5, (None, 2.0): 0.0, ("g", 0.0): 1.0, ("g", 1.0): 0.0}
    with pytest.raises(Exception, match="NULL in column days"):
        S.km_curve(spark.createDataFrame([("g", None), ("g", 1.0)], "goal string, days double"), "goal", "days").collect()
    with pytest.raises(Exception, match="NULL in column obs"):
        S.km_curve(spark.createDataFrame([("g", 1.0, None)], "goal string, days double, obs int"), "goal", "days", "obs").collect()
