"""Known answers on the hand-made edge fixture C (FIXTURES.md §4) with the default vocabulary."""

import math

import pytest
from pyspark.sql import functions as F

from orgpulse import REFERENCE_GOALS
from orgpulse.functions.goals import with_distinct_detail_goals
from orgpulse.operators import features as FT
from orgpulse.operators import goals as G
from orgpulse.operators import journey as J
from orgpulse.operators import metrics as M
from orgpulse.operators import profile as P
from orgpulse.operators import quality as Q
from orgpulse.operators.staging import stage, stage_window
from orgpulse.plans.marts import build_tables

GOALS = REFERENCE_GOALS


def approx(a, b, tol=1e-6):
    return a is not None and b is not None and abs(a - b) <= tol


@pytest.fixture(scope="module")
def profile_c(events_c):
    return G.org_goal_profile(events_c, GOALS).cache()


def test_staging_seconds_are_exact_floors(events_c):
    got = {r.event_id: r.time_since_first_activity for r in stage(events_c).collect()}
    assert got == {1: 0, 2: 0, 3: 60, 4: 86400, 5: 90000, 6: 172800, 7: 172800, 8: 345600,
                   9: 0, 10: 0, 11: 1, 12: 3, 13: 0, 14: 1}
    window_form = {r.event_id: r.time_since_first_activity for r in stage_window(events_c).collect()}
    assert window_form == got


def test_staging_without_broadcast_keeps_null_orgs(raw_c):
    # the shuffle-join branch and a NULL organization (null_org="keep") keep every row
    assert stage(raw_c, max_broadcast_rows=0).count() == 14


def test_goal_flags(profile_c):
    flags = {r.organization_id: tuple(r[g.column] for g in GOALS)
             for r in G.goal_flags(profile_c, GOALS).collect()}
    assert flags == {"A": (1, 1, 1, 1, 1), "B": (0, 0, 0, 0, 0), "C": (0, 0, 0, 0, 1), "nan": (0, 1, 0, 0, 0)}


def test_activation(profile_c):
    flags = G.goal_flags(profile_c, GOALS)
    assert [r.organization_id for r in G.fully_activated(flags, GOALS).collect()] == ["A"]
    r = M.activation_rate(profile_c, GOALS).first()
    assert (r.activated_orgs, r.total_orgs, r.activation_rate) == (1, 4, 0.25)
    assert M.activated_span_days(profile_c, GOALS).first().avg_days == pytest.approx(4.0)


def test_completion_rates(profile_c):
    rates = [r.rate for r in M.goal_completion_rates(profile_c, GOALS).collect()]
    assert rates == [0.25, 0.5, 0.25, 0.25, 0.5]


def test_completing_event(events_c):
    marks = J.completing_events(events_c, GOALS).filter("completes_activation").collect()
    assert [(r.organization_id, r.event_id) for r in marks] == [("A", 7)]
    t = J.activation_times(events_c, GOALS).collect()
    assert [(r.organization_id, r.event_id, r.seconds_since_first) for r in t] == [("A", 7, 172800)]


def test_feature_engagement(events_c):
    got = {r.activity_detail: r.rate for r in M.feature_engagement(events_c, GOALS[-1]).collect()}
    assert got == {"revenue": 0.5, "availability": 0.25}


def test_goal_times(profile_c):
    got = [r.avg_days for r in M.goal_times(profile_c, GOALS).collect()]
    for a, b in zip(got, [0.0, 0.000347, 1.0, 1.041667, 1.000006]):
        assert approx(a, b)


def test_time_to_advanced_goal_distinct_details(events_c):
    rows = J.time_to_goal(events_c, GOALS).filter(F.col("goal") == "advanced_features").collect()
    assert [(r.organization_id, r.days) for r in rows] == [("A", 2.0)]
    # With row counts C also reaches the goal
    both = with_distinct_detail_goals(GOALS)
    assert both[-1].distinct_details and not GOALS[-1].distinct_details


def test_goal_reach_distinct_details(events_c):
    specs = with_distinct_detail_goals(GOALS)
    reach = J.goal_reach_events(events_c, specs).filter(F.col("goal") == "advanced_features").collect()
    # second distinct detail for A is 'availability' (event 8); C views only 'revenue'
    assert [(r.organization_id, r.event_id) for r in reach] == [("A", 8)]


def test_correlation(profile_c):
    flags = G.goal_flags(profile_c, GOALS)
    got = {(r.col_a, r.col_b): r.corr for r in P.correlation_matrix(flags, [g.column for g in GOALS]).collect()}
    assert approx(got[("goal_shift_created", "goal_employee_invited")], 0.577350)
    assert approx(got[("goal_shift_created", "goal_punched_in")], 1.0)
    assert approx(got[("goal_employee_invited", "goal_advanced_features")], 0.0)
    assert got[("goal_employee_invited", "goal_shift_created")] == got[("goal_shift_created", "goal_employee_invited")]


def test_time_features(events_c):
    got = {r.organization_id: r for r in FT.org_time_features(events_c).collect()}
    b, a = got["B"], got["A"]
    assert (b.day_of_week_mean, b.day_of_week_std, b.hour_of_day_mean, b.trial_duration) == (4.0, None, 0.0, 0.0)
    assert a.day_of_week_mean == pytest.approx(4.375)
    assert approx(a.day_of_week_std, 1.597990)
    assert a.hour_of_day_mean == pytest.approx(9.125)
    assert a.trial_duration == pytest.approx(4.0)


def test_quality_checks(raw_c, events_c):
    atomic = Q.check_atomic_values(events_c).first()
    assert (atomic.observed, atomic.passed) == (1, False)
    nulls = {r.check: r.observed for r in Q.check_nulls(raw_c).collect()}
    assert nulls == {"null_organization_id": 2, "null_activity_name": 0, "null_timestamp": 0}
    tables = build_tables(raw_c, GOALS)
    for check in (Q.table_counts(tables), Q.org_intersection(tables), Q.check_org_coverage(tables),
                  Q.check_flag_domain(tables.table("goals"), GOALS), Q.check_constraints(tables, GOALS),
                  Q.tables_not_empty(tables), Q.check_goal_totals(tables, GOALS)):
        assert all(r.passed for r in check.collect()), check.collect()


def test_failing_checks_fail(spark, raw_c):
    tables = build_tables(raw_c, GOALS)
    broken = tables.table("goals").withColumn("goal_punched_in", F.lit(1))
    from orgpulse.sources.tables import TableSet
    bad = TableSet({**dict(tables.items()), "goals": broken})
    totals = {r.check: r.passed for r in Q.check_goal_totals(bad, GOALS).collect()}
    assert totals["goal_punched_in"] is False
    dup = TableSet({**dict(tables.items()), "goals": tables.table("goals").unionByName(tables.table("goals"))})
    cons = {r.check: r.observed for r in Q.check_constraints(dup, GOALS).collect()}
    assert cons["goals.organization_id_duplicates"] == 4
    empty = TableSet({**dict(tables.items()), "activation": tables.table("activation").limit(0)})
    ne = {r.check: r.passed for r in Q.tables_not_empty(empty).collect()}
    assert ne["activation_rows"] is False


def test_empty_input_c0(spark, events_c):
    empty = events_c.limit(0)
    profile = G.org_goal_profile(empty, GOALS)
    r = M.activation_rate(profile, GOALS).first()
    assert (r.activated_orgs, r.total_orgs, r.activation_rate) == (0, 0, 0.0)
    assert M.activated_span_days(profile, GOALS).first().avg_days == 0.0
    assert all(r.avg_days is None for r in M.goal_times(profile, GOALS).collect())
    assert all(r.rate is None for r in M.goal_completion_rates(profile, GOALS).collect())
    assert all(r.probability == 0.0 for r in M.goal_reached_within_days(profile, GOALS, 30).collect())


def test_constant_columns_c1(spark, events_c):
    a = events_c.filter(F.col("organization_id") == "A")
    two = a.unionByName(a.withColumn("organization_id", F.lit("A2")).withColumn("event_id", F.col("event_id") + 100))
    flags = G.goal_flags(G.org_goal_profile(two, GOALS), GOALS)
    rows = P.correlation_matrix(flags, [g.column for g in GOALS]).collect()
    assert len(rows) == 25 and all(r.corr is None for r in rows)


def test_describe_matches_pandas(spark, events_c):
    import pandas as pd
    staged = stage(events_c)
    got = {(r.column_name, r.stat): (r.value, r.value_ts) for r in
           P.describe(staged, ["timestamp", "time_since_first_activity"]).collect()}
    pdf = staged.select("time_since_first_activity").toPandas()["time_since_first_activity"].describe()
    for stat in ("count", "mean", "std", "min", "25%", "50%", "75%", "max"):
        assert math.isclose(got[("time_since_first_activity", stat)][0], float(pdf[stat]), rel_tol=1e-12)
    tsd = pd.Series(pd.to_datetime([r.timestamp for r in staged.select("timestamp").collect()])).describe()
    for stat in ("min", "25%", "50%", "75%", "max"):
        # pandas interpolates through float64 nanoseconds (256 ns steps here): allow 1 µs
        assert abs(pd.Timestamp(got[("timestamp", stat)][1]) - tsd[stat]) <= pd.Timedelta("1us")


def test_span_with_semi_join_equals_profile_form(events_c, profile_c):
    flags = G.goal_flags(profile_c, GOALS)
    act = G.fully_activated(flags, GOALS)
    a = M.activated_span_days(profile_c, GOALS).first()
    b = M.activated_span_days(profile_c, GOALS, activated=act).first()
    assert (a.activated_orgs, a.avg_days) == (b.activated_orgs, b.avg_days) == (1, 4.0)


def test_written_marts_are_idempotent(spark, raw_c):
    from orgpulse.plans.marts import TABLE_ORDER, write_marts
    from orgpulse.session import scratch_path
    out = scratch_path(spark, "marts-test")
    first = write_marts(spark, raw_c, GOALS, out)
    counts = {n: first.table(n).count() for n in TABLE_ORDER}
    again = write_marts(spark, raw_c, GOALS, out)   # full refresh: same folders overwritten
    assert {n: again.table(n).count() for n in TABLE_ORDER} == counts == \
        {"raw": 14, "staging": 14, "goals": 4, "activation": 1}
    assert again.list_tables() == list(TABLE_ORDER)
    assert all(r.passed for r in Q.check_goal_totals(again, GOALS).collect())


def test_goal_analytics_report(events_c):
    from orgpulse.plans.analytics import GoalAnalytics
    ga = GoalAnalytics(events_c)
    rep = ga.report()
    assert rep["activation_rate"] == 0.25
    assert rep["time_to_activation_days"] == pytest.approx(4.0)
    assert rep["goal_completion_rates"]["Employee Invited"] == 0.5
    assert rep["feature_engagement_rates"] == {"revenue": 0.5, "availability": 0.25}
    assert rep["goal_achievement_days"]["Punch In Approved"] == pytest.approx(1.041667, abs=1e-6)
    curves = ga.survival_curves().collect()
    assert {r.goal for r in curves} == {g.name for g in GOALS}
    ga.unpersist()


def test_goals_from_json_equal_reference_vocabulary():
    import json
    from dataclasses import asdict
    from orgpulse.functions.goals import goals_from_json
    text = json.dumps([{**asdict(g), "details": list(g.details) if g.details else None} for g in GOALS])
    assert goals_from_json(text) == GOALS
    with pytest.raises(ValueError):
        goals_from_json('[{"name": "a", "activity_name": "x"}, {"name": "a", "activity_name": "y"}]')


def test_null_organization_kept_as_a_group(raw_c, spark):
    # null_org="keep": with a one-goal vocabulary (an invitation) the NULL organization completes too
    invite = (GOALS[1],)
    marks = J.completing_events(raw_c, invite).filter("completes_activation").collect()
    assert {(r.organization_id, r.event_id) for r in marks} == {("A", 3), (None, 13)}
    times = {r.organization_id: r.seconds_since_first for r in J.activation_times(raw_c, invite).collect()}
    assert times == {"A": 60, None: 0}


def test_window_staging_falls_back_above_the_bound(events_c, monkeypatch):
    import orgpulse.operators.common as common
    monkeypatch.setattr(common, "SINGLE_TASK_ROWS", 3)   # organization A has 8 events
    got = {r.event_id: r.time_since_first_activity for r in stage_window(events_c).collect()}
    assert got[7] == 172800 and len(got) == 14


def test_analytics_cli_prints_report(spark, events_c, capsys):
    from orgpulse.plans.analytics import GoalAnalytics, main
    from orgpulse.session import scratch_path
    path = scratch_path(spark, "cli-events")
    events_c.write.parquet(path)
    assert main(["--events", path], spark=spark) == 0
    out = capsys.readouterr().out
    assert "activation_rate\t\t0.25\n" in out and "feature_engagement_rates\trevenue\t0.5\n" in out
    no_details = GoalAnalytics(events_c, GOALS[:2])
    assert no_details.report()["feature_engagement_rates"] == {}
    with pytest.raises(ValueError):
        no_details.feature_engagement_rates()


def test_predicate_sql_and_column_forms_agree(spark):
    from pyspark.sql import functions as F
    from orgpulse.functions.goals import GoalSpec
    rows = [(1, "o", "Page.Viewed", "revenue", None), (2, "o", "Page.Viewed", None, None),
            (3, "o", "It's", "a\\\\b", None), (4, "o", "It's", "x", None), (5, "o", None, "revenue", None)]
    from conftest import EVENT_SCHEMA
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    plain = GoalSpec("p", "P", "Page.Viewed", ("revenue", "availability"), 1)
    quoted = GoalSpec("q", "Q", "It's", ("a\\\\b",), 1)            # falls back to the Column form
    assert [r.event_id for r in df.filter(plain.predicate()).collect()] == [1]
    assert [r.event_id for r in df.filter(quoted.predicate()).collect()] == [3]
    # NULL semantics: a NULL name or detail never matches, as with Column == / isin
    assert df.filter(F.coalesce(plain.predicate(), F.lit(False))).count() == 1


def test_goal_achievement_probability_signatures(events_c):
    from orgpulse.plans.analytics import GoalAnalytics
    ga = GoalAnalytics(events_c)
    assert ga.goal_achievement_probability(30).count() == 5
    one = ga.goal_achievement_probability("goal_employee_invited", 30).collect()
    assert [(r.goal, r.probability) for r in one] == [("employee_invited", 0.5)]
    assert ga.goal_achievement_probability("punched_in", 0.5).first().probability == 0.0
    assert ga.advanced_features_rate().count() == 2
    with pytest.raises(ValueError):
        ga.goal_achievement_probability("nope", 1)
    ga.unpersist()
