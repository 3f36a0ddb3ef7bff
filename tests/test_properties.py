"""Random event logs: Spark operators against a direct Python replay (the brute-force
definition — walk each organization's events in (timestamp, event_id) order and re-test the
goals after every event)."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from orgpulse.functions.goals import GoalSpec
from orgpulse.operators import goals as G
from orgpulse.operators import journey as J

from conftest import EVENT_SCHEMA

GOALS = (
    GoalSpec("a2", "A twice", "a", None, 2),
    GoalSpec("b1", "B once", "b", None, 1),
    GoalSpec("cx", "C on x or y twice", "c", ("x", "y"), 2),
)
DISTINCT = (GOALS[0], GOALS[1], GOALS[2].with_distinct_details(True))
T0 = dt.datetime(2024, 1, 1)

events_strategy = st.lists(
    st.tuples(st.sampled_from(["o1", "o2", "o3"]), st.sampled_from(["a", "b", "c", "d"]),
              st.sampled_from(["x", "y", "z", None]), st.integers(min_value=0, max_value=6)),
    min_size=0, max_size=40)


def matches(g: GoalSpec, name, detail) -> bool:
    return name == g.activity_name and (not g.details or detail in g.details)


def replay(rows, goals):
    """org -> event_id of the completing event, by brute force."""
    out = {}
    for org in {r[1] for r in rows}:
        seen = []
        for r in sorted((r for r in rows if r[1] == org), key=lambda r: (r[4], r[0])):
            seen.append(r)
            ok = True
            for g in goals:
                hits = [s for s in seen if matches(g, s[2], s[3])]
                progress = len({s[3] for s in hits}) if g.distinct_details else len(hits)
                ok &= progress >= g.min_count
            if ok:
                out[org] = r[0]
                break
    return out


def to_rows(raw):
    return [(i + 1, org, name, detail, T0 + dt.timedelta(hours=h)) for i, (org, name, detail, h) in enumerate(raw)]


@settings(max_examples=12, deadline=None)
@given(events_strategy)
def test_completing_event_equals_replay(spark, raw):
    rows = to_rows(raw)
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    for goals in (GOALS, DISTINCT):
        got = {r.organization_id: r.event_id for r in J.completion_points(df, goals).collect()}
        assert got == replay(rows, goals)


@settings(max_examples=12, deadline=None)
@given(events_strategy)
def test_flags_and_first_times_equal_python(spark, raw):
    rows = to_rows(raw)
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    prof = G.org_goal_profile(df, GOALS)
    flags = {r.organization_id: tuple(r[g.column] for g in GOALS) for r in G.goal_flags(prof, GOALS).collect()}
    secs = {r.organization_id: tuple(r[g.first_seconds_column] for g in GOALS)
            for r in G.goal_first_seconds(prof, GOALS).collect()}
    for org in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == org]
        first = min(r[4] for r in mine)
        want_flags, want_secs = [], []
        for g in GOALS:
            hits = [r for r in mine if matches(g, r[2], r[3])]
            want_flags.append(int(len(hits) >= g.min_count))
            want_secs.append(int((min(r[4] for r in hits) - first).total_seconds()) if hits else None)
        assert flags[org] == tuple(want_flags)
        assert secs[org] == tuple(want_secs)
    activated = {r.organization_id for r in G.fully_activated(G.goal_flags(prof, GOALS), GOALS).collect()}
    assert activated == set(replay(rows, GOALS))


@settings(max_examples=6, deadline=None)
@given(events_strategy)
def test_completing_event_large_k_path_equals_replay(spark, raw):
    # force the path used when K exceeds Spark's window-group-limit threshold, both strategies
    import orgpulse.operators.common as common
    rows = to_rows(raw)
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1")
    saved = common.SINGLE_TASK_ROWS
    try:
        for bound in (0, saved):
            common.SINGLE_TASK_ROWS = bound
            for goals in (GOALS, DISTINCT):
                got = {r.organization_id: r.event_id for r in J.completion_points(df, goals).collect()}
                assert got == replay(rows, goals)
    finally:
        common.SINGLE_TASK_ROWS = saved
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
