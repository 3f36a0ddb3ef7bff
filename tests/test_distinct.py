"""Distinct counts from merged bitmaps against count(DISTINCT ...)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orgpulse.functions.goals import DETAIL, ORG, REFERENCE_GOALS
from orgpulse.operators import distinct as D
from orgpulse.operators import metrics as M
from orgpulse.sources.versions import Build, VersionedTables
from tests.conftest import EVENT_SCHEMA


def log(spark, seed, n, orgs):
    """Events with NULL organizations, details and times; one organization has a third of them."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 4 + [None] + [f"o{rng.randrange(orgs)}" for _ in range(7)]), "Page.Viewed",
             rng.choice(["revenue", "availability", "other", None]),
             rng.choice([None] + [dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(500)) for _ in range(9)])) for i in range(n)]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def plain(events, by):
    return {tuple(r)[:-1]: r.n for r in events.where(F.col(ORG).isNotNull()).groupBy(*by).agg(F.count_distinct(ORG).alias("n")).collect()}


def counted(state, by):
    return {tuple(r)[:-1]: r.members for r in D.distinct_counts(state, by).collect()}


def test_numbers_are_dense_and_stay(spark):
    one, two = log(spark, 1, 300, 60), log(spark, 2, 300, 120)
    first = D.number_members(one)
    both = {r[ORG]: r.member_number for r in D.extend_numbers(first, two).collect()}
    assert sorted(both.values()) == list(range(1, len(both) + 1)) and None not in both
    assert {r[ORG]: r.member_number for r in first.collect()}.items() <= both.items()
    assert D.extend_numbers(first, one).count() == first.count()


def test_a_merge_of_days_is_the_whole(spark, tmp_path):
    store, by = VersionedTables(spark, str(tmp_path / "states")), [DETAIL]
    days = [log(spark, k, 400, 50 * (k + 1)) for k in range(3)]
    for k, day in enumerate(days + [days[1]]):  # the last day comes twice
        state = D.add_events(store, day, by)
        whole = days[0]
        for d in days[1:k + 1]:
            whole = whole.union(d)
        assert counted(state, by) == plain(whole, by)
    assert counted(D.merged(state), []) == plain(whole, [])
    with store.read() as tables:
        assert tables.table("numbers").count() == whole.select(ORG).distinct().count() - 1


def test_a_failed_refresh_leaves_the_earlier_state(spark, tmp_path, monkeypatch):
    store, day = VersionedTables(spark, str(tmp_path / "states")), log(spark, 4, 200, 30)
    D.add_events(store, day, [DETAIL])
    write = Build.write
    monkeypatch.setattr(Build, "write", lambda self, name, df: write(self, name, df) if name == "numbers" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        D.add_events(store, log(spark, 5, 200, 90), [DETAIL])
    with store.read() as tables:
        assert counted(tables.table("states"), [DETAIL]) == plain(day, [DETAIL])


def test_members_beyond_one_block(spark):
    events = spark.range(100_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias(ORG), (F.col("id") + 1).alias(D.NUMBER))
    state = D.distinct_state(events.union(events), ["g"])
    assert state.count() == 12 and counted(state, ["g"]) == plain(events, ["g"])
    assert counted(D.merged(state, state), []) == {(): 100_000}


def test_engagement_by_month(spark):
    events = log(spark, 7, 1500, 200)
    goal = next(g for g in REFERENCE_GOALS if g.details)
    state, numbers = D.monthly_engagement(events, goal)
    assert {tuple(r) for r in D.feature_engagement_from(state, numbers).collect()} == {
        tuple(r) for r in M.feature_engagement(events, goal).collect()}
    hits = [(r[DETAIL], r.month, r[ORG]) for r in events.where(goal.predicate()).where(F.col(ORG).isNotNull()).select(
        DETAIL, ORG, D.month_of(F.col("timestamp")).alias("month")).collect()]
    same_year = lambda x, y: (x is None and y is None) or (x and y and x.year == y.year and x <= y)
    want = {(d, m, len({o for e, n, o in hits if (e, n) == (d, m)}), len({o for e, n, o in hits if e == d and same_year(n, m)}),
             len({o for e, _, o in hits if e == d})) for d, m, _ in hits}
    assert {tuple(r) for r in D.engaged_by_month(state).collect()} == want and any(m is None for _, m, _ in hits)


def test_no_events(spark):
    none = log(spark, 1, 5, 5).where("false")
    state, numbers = D.monthly_engagement(none, REFERENCE_GOALS[0])
    assert state.count() == numbers.count() == D.engaged_by_month(state).count() == 0


def test_what_is_shuffled_is_a_bitmap_per_group_and_block(spark):
    events = log(spark, 1, 50, 5)
    state = D.distinct_state(events.withColumn(D.NUMBER, F.lit(1)), [DETAIL])
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan and plan.count("Exchange") == 1 and ORG not in plan.split("Exchange")[1].split("partial_")[0]
