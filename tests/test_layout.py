"""Tables laid out by organization: results, plans without a shuffle below the join, balance of a large organization."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orgpulse.functions.goals import ORG, REFERENCE_GOALS, GoalSpec
from orgpulse.operators import colocated as B
from orgpulse.operators import goals as G
from orgpulse.operators import metrics as M
from orgpulse.operators import quality as Q
from orgpulse.plans.marts import build_tables, built_by_org, drop_builds
from orgpulse.sources import layout as L
from orgpulse.sources.versions import VersionedTables
from tests.conftest import EVENT_SCHEMA

GOALS = (GoalSpec("seen", "Seen", "Page.Viewed", ("a", "b"), 2, True), GoalSpec("made", "Made", "Shift.Created", None, 3))


@pytest.fixture(scope="module")
def events(spark):
    """6,000 events, a third of one organization."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"o{rng.randrange(900)}", rng.choice(["Page.Viewed", "Shift.Created"]),
             rng.choice(["a", "b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(500_000))) for i in range(6000)]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


@pytest.fixture(scope="module")
def laid_out(spark, events):
    return built_by_org(spark, events, GOALS, buckets=16)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_results_equal_the_plain_checks(events, laid_out):
    plain = build_tables(events, GOALS)
    assert rows_of(B.check_org_coverage(laid_out)) == rows_of(Q.check_org_coverage(plain))
    assert rows_of(B.check_goal_totals(laid_out, GOALS)) == rows_of(Q.check_goal_totals(plain, GOALS))
    got = B.activated_span_days(laid_out.table("events"), laid_out.table("activation")).first()
    want = M.activated_span_days(G.org_goal_profile(events, GOALS), GOALS).first()
    assert got.activated_orgs == want.activated_orgs > 1 and got.avg_days == pytest.approx(want.avg_days, rel=1e-12)
    flags = plain.table("goals")
    assert sorted(rows_of(L.plain(laid_out.table("goals")))) == sorted(rows_of(flags))
    assert sorted(rows_of(laid_out.table("events").drop(L.SALT)), key=str) == sorted(rows_of(events), key=str)


def test_no_bucket_holds_much_more_than_two_average_ones(laid_out):
    rows = Counter(r.f for r in laid_out.table("events").select(F.input_file_name().alias("f")).collect())
    assert len(rows) <= 16 and max(rows.values()) <= 3 * 6000 / 16
    assert laid_out.table("events").where("organization_id = 'hot'").select(L.SALT).distinct().count() == 6


def test_nothing_is_shuffled_below_the_joins(laid_out):
    events, flags, activated = (laid_out.table(n) for n in ("events", "goals", "activation"))
    for df in (B.coverage(events, flags), B.activated_span_days(events, activated)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("SortMergeJoin"):]
        assert "Exchange" not in below and below.count("Bucketed: true") == 2
    plan = B.goal_totals(events, GOALS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of one row per organization and salt
    assert plan.index("Exchange hashpartitioning") < plan.index("org_salt")


def test_a_missing_organization_is_seen(spark, laid_out):
    less = laid_out.table("goals").where("organization_id not in ('hot', 'o1')")
    found = B.coverage(laid_out.table("events"), less).first()
    assert found.staging_orgs - found.goal_orgs == 2


def test_null_and_no_organizations(spark, raw_c, events, tmp_path):
    tables = built_by_org(spark, raw_c, REFERENCE_GOALS, null_org="keep", buckets=3)
    assert tuple(B.coverage(tables.table("events"), tables.table("goals")).first()) == (3, 3)
    assert tables.table("events").where(F.col(ORG).isNull()).count() == 2
    assert L.plain(tables.table("goals")).where(F.col(ORG).isNull()).count() == 1
    none = built_by_org(spark, events.where("false"), GOALS, buckets=3)
    assert tuple(B.coverage(none.table("events"), none.table("goals")).first()) == (0, 0)
    assert B.activated_span_days(none.table("events"), none.table("activation")).first().activated_orgs == 0


def test_versions_open_with_their_buckets_and_leave_no_catalog_entry(spark, events, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "it's here"))
    layout = L.layout_of(events, 4)
    with store.build() as build:
        build.write_laid_out("events", L.salted_events(events, layout), layout)
        build.write("numbers", spark.range(3))
    with store.read() as tables:
        assert tables.table("events").count() == 6000 and tables.table("numbers").count() == 3
        plan = tables.table("events").groupBy(*L.KEYS).count()._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange" not in plan
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("orgpulse_")] == []


def test_one_build_serves_many(spark, events, tmp_path):
    drop_builds(spark)
    events.write.parquet(str(tmp_path / "log"))
    read = lambda: built_by_org(spark, spark.read.parquet(str(tmp_path / "log")), GOALS, buckets=4)
    files = lambda: set(read().table("events").inputFiles())
    first = files()
    assert first and files() == first
    events.limit(10).write.mode("append").parquet(str(tmp_path / "log"))
    assert not files() & first
