"""Distribution helpers against their plain (single-window / pandas) equivalents."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from orgpulse.operators.common import broadcast_if_small, running_totals
from orgpulse.operators.profile import describe, exact_quantiles


def test_running_totals_equal_plain_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 4).alias("g"), F.col("id").alias("o"),
                                     ((F.col("id") * 31) % 17).alias("x"))
    got = running_totals(df, by=["g"], order=["o"], sums=["x"], parts=7, single_task_rows=0)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("cum_x", F.sum("x").over(w))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_running_totals_without_groups(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("o"), F.lit(1).alias("one"))
    got = {r.o: r.cum_one for r in running_totals(df, by=[], order=["o"], sums=["one"], parts=5,
                                                    single_task_rows=0).collect()}
    assert all(got[o] == o for o in range(1, 1001))


def test_running_totals_branches_agree(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), F.lit(2).alias("x"))
    a = running_totals(df, by=["g"], order=["o"], sums=["x"], parts=5, single_task_rows=0)
    b = running_totals(df, by=["g"], order=["o"], sums=["x"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_broadcast_if_small_bound(spark):
    df = spark.range(10)
    _, n = broadcast_if_small(df, max_rows=5)
    assert n == 10


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=-1000, max_value=1000), min_size=1, max_size=60),
       st.sampled_from([0, 10_000]))
def test_exact_quantiles_match_pandas(spark, values, bound):
    import orgpulse.operators.common as common
    common.SINGLE_TASK_ROWS, saved = bound, common.SINGLE_TASK_ROWS  # 0: force the two-level path
    df = spark.createDataFrame([("c", float(v)) for v in values], "k string, v double")
    rows = exact_quantiles(df, "k", "v", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()
    s = pd.Series(values, dtype="float64")
    for r in rows:
        got = r.lo_value + r.frac * (r.hi_value - r.lo_value)
        assert abs(got - s.quantile(r.prob)) < 1e-9
    common.SINGLE_TASK_ROWS = saved


def test_describe_rejects_strings(spark):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    try:
        describe(df, ["s", "n"])
    except ValueError:
        return
    raise AssertionError("describe accepted a string column")


def test_describe_all_null_column(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "n bigint, t timestamp_ntz")
    rows = {(r.column_name, r.stat): (r.value, r.value_ts) for r in describe(df, ["n", "t"]).collect()}
    assert rows[("n", "count")] == (0.0, None) and rows[("n", "mean")] == (None, None)
    assert rows[("t", "mean")] == (None, None)


def test_cached_sides_live_as_long_as_their_result(spark):
    import gc

    from orgpulse.operators.common import holding
    side, n = broadcast_if_small(spark.range(5), max_rows=10)
    cached = side._orgpulse_sides[0]._jdf
    assert n == 5 and cached.storageLevel().useMemory()
    result = holding(spark.range(9).join(side, "id"), side)
    del side
    gc.collect()
    assert cached.storageLevel().useMemory() and result.count() == 5
    del result
    gc.collect()
    assert not cached.storageLevel().useMemory()


def test_broadcast_is_bounded_in_bytes(spark):
    wide = spark.range(40).selectExpr("id", "repeat('x', 1000) as t")
    spark.conf.set("spark.orgpulse.broadcastBytes", "20000")
    try:
        side, _ = broadcast_if_small(wide)
        plan = spark.range(9).join(side, "id")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.orgpulse.broadcastBytes")


def test_null_groups_have_running_totals_on_both_paths(spark):
    df = spark.createDataFrame([(None, 1, 5), ("a", 1, 2), (None, 2, 7), ("a", 2, 1), (None, 3, 1)], "g string, o int, x int")
    one = running_totals(df, by=["g"], order=["o"], sums=["x"])
    two = running_totals(df, by=["g"], order=["o"], sums=["x"], parts=3, single_task_rows=0)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(one) == rows(two) and one.count() == 5


def test_completion_of_a_null_organization_on_both_paths(spark, raw_c):
    from orgpulse.functions.goals import REFERENCE_GOALS
    from orgpulse.operators import journey as J
    invite = (REFERENCE_GOALS[1],)
    want = sorted(map(str, J.completion_points(raw_c, invite).collect()))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "0")
    spark.conf.set("spark.orgpulse.singleTaskRows", "0")
    try:
        assert sorted(map(str, J.completion_points(raw_c, invite).collect())) == want and len(want) == 2
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
        spark.conf.unset("spark.orgpulse.singleTaskRows")


def test_org_intersection_combines_before_its_only_shuffle_by_organization(spark, raw_c):
    from orgpulse.functions.goals import REFERENCE_GOALS
    from orgpulse.operators.quality import org_intersection
    from orgpulse.plans.marts import write_marts
    plan = org_intersection(write_marts(spark, raw_c, REFERENCE_GOALS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(organization_id") == 1 and "Join" not in plan


def test_goal_totals_follow_distinct_details(spark, events_c):
    from orgpulse.functions.goals import REFERENCE_GOALS, with_distinct_detail_goals
    from orgpulse.operators.quality import check_goal_totals
    from orgpulse.plans.marts import checked
    goals = with_distinct_detail_goals(REFERENCE_GOALS)
    rows = checked(spark, events_c, goals, lambda t: check_goal_totals(t, goals)).collect()
    assert len(rows) == 5 and all(r.passed for r in rows)


def test_distinct_detail_goals_need_no_expand(spark):
    from orgpulse.operators.journey import time_to_goal
    from orgpulse.sources.adapters import STREAM_GOALS, fixture_b
    plan = time_to_goal(fixture_b(spark, "/root/testdata/sf0.001"), STREAM_GOALS)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_describe_skips_nan_and_correlation_rejects_texts(spark):
    import pytest

    from orgpulse.operators.profile import correlation_matrix
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "x double")
    got = {r.stat: r.value for r in describe(df, ["x"]).collect()}
    assert (got["count"], got["mean"], got["max"], got["50%"]) == (2.0, 1.5, 2.0, 1.5)
    with pytest.raises(ValueError):
        correlation_matrix(df.selectExpr("string(x) AS x"), ["x"])


def test_correlation_of_doubles_with_large_offsets(spark):
    import math
    import random

    import pandas as pd
    import pytest

    from orgpulse.operators.profile import correlation_matrix
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a = rng.gauss(0, 1)
        rows.append((1.7e9 + a, 1.7e9 + 0.5 * a + rng.gauss(0, 1), None if i % 7 == 0 else a, 4.25,
                     math.nan if i % 11 == 0 else rng.random(), i % 2 == 0, i))
    names = ["a", "b", "c", "flat", "gaps", "flag", "n"]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, gaps double, flag boolean, n int")
    want = pd.DataFrame(rows, columns=names).astype({"flag": int}).corr()
    for parts in (1, 7):
        got = {(r.col_a, r.col_b): r["corr"] for r in correlation_matrix(df.repartition(parts), names).collect()}
        assert len(got) == 49
        for x in names:
            for y in names:
                if "flat" in (x, y):
                    assert got[x, y] is None
                else:
                    assert got[x, y] == pytest.approx(want.loc[x, y], abs=1e-6)
    assert {r["corr"] for r in correlation_matrix(df.where("false"), ["a", "b"]).collect()} == {None}


def test_classifier_reaches_the_minimum_of_its_loss(spark):
    import math

    from orgpulse.operators.classify import train_and_predict
    rows = [(str(i), "train" if i % 5 else "test", int((i * 7919) % 100 < 50 + 40 * math.sin(i)), math.sin(i), math.cos(3 * i))
            for i in range(400)]
    df = spark.createDataFrame(rows, "organization_id string, split string, label int, a double, b double")
    got = train_and_predict(df, ["a", "b"], reg_param=0.0).collect()
    assert len(got) == 80 and all(0 <= r.probability <= 1 and r.prediction == int(r.probability > 0.5) for r in got)
    # on all rows as test rows too: at the minimum the residuals are orthogonal to every feature
    both = df.union(df.where("split = 'train'").selectExpr("organization_id || 't'", "'test'", "label", "a", "b"))
    fitted = {r.organization_id: r for r in train_and_predict(both, ["a", "b"], reg_param=0.0, max_iter=200).collect()}
    train = [r for r in rows if r[1] == "train"]
    for feature in (lambda r: 1.0, lambda r: r[3], lambda r: r[4]):
        assert abs(sum((fitted[r[0] + "t"].probability - r[2]) * feature(r) for r in train)) < 1e-2 * len(train)
