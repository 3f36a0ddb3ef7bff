"""Data-quality checks (V1–V11).  Each returns rows ``(check, observed, expected, passed)``
computed in Spark; only those few rows reach the driver.  ``expected`` is NULL for purely
informational rows, which always pass.

The checks read a :class:`~orgpulse.sources.tables.TableSet` with the tables ``raw``,
``staging``, ``goals`` and ``activation`` (see :func:`orgpulse.plans.marts.build_tables`).  Figures that the
build counted while it wrote the tables (``TableSet.stats``) are taken from there.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions.goals import DETAIL, EVENT_ID, NAME, ORG, TS, GoalSpec
from orgpulse.operators.staging import FIRST_TS
from orgpulse.sources.tables import TableSet

CHECK_COLUMNS = ("check", "observed", "expected", "passed")


def _row(name: str, observed: Column, expected: Column | None = None, passed: Column | None = None) -> Column:
    observed = observed.cast("bigint")
    if passed is None:
        passed = F.lit(True) if expected is None else observed == expected.cast("bigint")
    expected = expected.cast("bigint") if expected is not None else F.lit(None).cast("bigint")
    return F.struct(F.lit(name).alias("check"), observed.alias("observed"),
                    expected.alias("expected"), F.coalesce(passed, F.lit(False)).alias("passed"))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Cross join of one-row aggregates (each side has exactly one row)."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def _checks(wide: DataFrame, rows: list[Column]) -> DataFrame:
    return wide.select(F.inline(F.array(*rows)))


def _figures(tables: TableSet, wanted: dict[str, tuple[str, str, Column]], *more: DataFrame) -> DataFrame:
    """One row of figures: ``wanted`` names each by (table, what the build counted, how to count it else), and
    ``more`` are one-row aggregates.  Figures of the build need no scan."""
    known = {k: tables.stats[t][s] for k, (t, s, _) in wanted.items() if s in tables.stats.get(t, {})}
    rest: dict[str, list[Column]] = {}
    for k, (t, _, count) in wanted.items():
        if k not in known:
            rest.setdefault(t, []).append(count.alias(k))
    frames = [tables.table(t).agg(*counts) for t, counts in rest.items()] + list(more)
    one = _one_row(*frames) if frames else tables.table(tables.list_tables()[0]).sparkSession.range(1)
    return one.select("*", *[F.lit(v).cast("bigint").alias(k) for k, v in known.items()])


def _n_rows() -> Column:
    return F.count(F.lit(1))


def table_counts(tables: TableSet) -> DataFrame:
    """V1 + V4: row counts and distinct organizations across the build."""
    orgs = [tables.table(t).agg(F.count_distinct(ORG).alias(f"{t}_orgs")) for t in ("raw", "staging")]
    names = {"raw": "raw", "staging": "staging", "goals": "goal", "activation": "activation"}
    c = F.col
    return _checks(_figures(tables, {f"{n}_rows": (t, "rows", _n_rows()) for t, n in names.items()}, *orgs), [
        _row("raw_rows", c("raw_rows")),
        _row("staging_rows", c("staging_rows"), c("raw_rows")),
        _row("raw_orgs", c("raw_orgs")),
        _row("staging_orgs", c("staging_orgs"), c("raw_orgs")),
        _row("goal_rows", c("goal_rows"), c("staging_orgs")),
        _row("activation_rows", c("activation_rows"), c("goal_rows"), c("activation_rows") <= c("goal_rows")),
    ])


def check_nulls(events: DataFrame) -> DataFrame:
    """V2: NULL organization, activity and timestamp counts (expected 0)."""
    wide = events.agg(*[F.count_if(F.col(col).isNull()).alias(col) for col in (ORG, NAME, TS)])
    return _checks(wide, [_row(f"null_{col}", F.col(col), F.lit(0)) for col in (ORG, NAME, TS)])


def check_time_range(events: DataFrame, lower=None, upper=None) -> DataFrame:
    """V3: earliest and latest event time; passes when both exist, are ordered and lie in the
    optional ``[lower, upper]`` bounds.  Columns: check, min_timestamp, max_timestamp, passed."""
    agg = events.agg(F.min(TS).alias("min_timestamp"), F.max(TS).alias("max_timestamp"))
    ok = F.col("min_timestamp").isNotNull() & (F.col("min_timestamp") <= F.col("max_timestamp"))
    if lower is not None:
        ok = ok & (F.col("min_timestamp") >= F.lit(lower).cast("timestamp_ntz"))
    if upper is not None:
        ok = ok & (F.col("max_timestamp") <= F.lit(upper).cast("timestamp_ntz"))
    return agg.select(F.lit("timestamp_range").alias("check"), "min_timestamp", "max_timestamp",
                      F.coalesce(ok, F.lit(False)).alias("passed"))


def check_org_coverage(tables: TableSet) -> DataFrame:
    """V5: distinct organizations of staging and how many of them the goals mart has
    (left join staging → goals; both sides made distinct before the join)."""
    s = tables.table("staging").select(ORG).distinct()
    g = tables.table("goals").select(F.col(ORG).alias("_g")).distinct()
    wide = (s.join(g, s[ORG] == g["_g"], "left")
            .agg(F.count_distinct(ORG).alias("staging_orgs"), F.count_distinct("_g").alias("goal_orgs")))
    return coverage_rows(wide)


def coverage_rows(counts: DataFrame) -> DataFrame:
    """The rows of V5 from one row ``staging_orgs, goal_orgs``."""
    return _checks(counts, [_row("staging_org_count", F.col("staging_orgs")),
                            _row("trial_goals_org_count", F.col("goal_orgs"), F.col("staging_orgs"))])


def org_intersection(tables: TableSet) -> DataFrame:
    """V6: organization ids agree over raw, staging and goals: equal distinct counts and an
    intersection as large as the raw set."""
    # one row per organization and table after map-side combining, then one count per organization
    names = ("raw", "staging", "goals")
    tagged = reduce(lambda a, b: a.union(b), [
        tables.table(n).select(ORG, *[F.lit(int(n == m)).alias(m) for m in names]) for n in names])
    per_org = tagged.groupBy(ORG).agg(*[F.max(n).alias(n) for n in names])
    named = F.col(ORG).isNotNull()
    counts = per_org.agg(*[F.count_if(named & (F.col(n) == 1)).alias(f"{n.replace('goals', 'goal')}_orgs") for n in names],
                         F.count_if(reduce(lambda a, b: a & b, [F.col(n) == 1 for n in names])).alias("common_orgs"))
    c = F.col
    return _checks(counts, [_row("raw_orgs", c("raw_orgs")),
                            _row("staging_orgs", c("staging_orgs"), c("raw_orgs")),
                            _row("goal_orgs", c("goal_orgs"), c("raw_orgs")),
                            _row("common_orgs", c("common_orgs"), c("raw_orgs"))])


def non_atomic(separator: str = ";") -> Column:
    return F.col(NAME).contains(separator) | F.col(DETAIL).contains(separator)


def check_atomic_values(events: DataFrame | TableSet, separator: str = ";") -> DataFrame:
    """V7: rows whose activity name or detail holds the separator (NULL never counts), of events or of a
    build's staging table."""
    bad = F.count_if(non_atomic(separator))
    if isinstance(events, TableSet):
        wide = _figures(events, {"bad": ("staging", "non_atomic" if separator == ";" else "", bad)})
    else:
        wide = events.agg(bad.alias("bad"))
    return _checks(wide, [_row("non_atomic_values", F.col("bad"), F.lit(0))])


def check_flag_domain(flags: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """V8: each goal column has at most two distinct values."""
    wide = flags.agg(*[F.count_distinct(g.column).alias(g.column) for g in goals])
    return _checks(wide, [_row(g.column, F.col(g.column), F.lit(2), F.col(g.column) <= 2) for g in goals])


def check_constraints(tables: TableSet, goals: Sequence[GoalSpec]) -> DataFrame:
    """V9: the declared keys and NOT NULL columns, and the documented foreign keys, which
    Spark does not enforce: duplicate keys, NULLs and orphans (expected 0 each)."""
    stg, gls, act = (tables.table(n) for n in ("staging", "goals", "activation"))
    null = lambda c: F.count_if(F.col(c).isNull())
    any_null_goal = reduce(lambda a, b: a | b, [F.col(g.column).isNull() for g in goals])
    nulls = {"stg_id_null": ("staging", "id_null", null(EVENT_ID)), "stg_org_null": ("staging", "org_null", null(ORG)),
             "stg_ts_null": ("staging", "ts_null", null(TS)), "stg_first_null": ("staging", "first_null", null(FIRST_TS)),
             "goal_org_null": ("goals", "org_null", null(ORG)), "goal_flag_null": ("goals", "flag_null", F.count_if(any_null_goal)),
             "act_org_null": ("activation", "org_null", null(ORG))}
    duplicates = [t.agg((F.count(F.lit(1)) - F.count_distinct(key)).alias(name)) for t, key, name in (
        (stg, EVENT_ID, "stg_dup"), (gls, ORG, "goal_dup"), (act, ORG, "act_dup"))]
    stg_orgs = stg.select(ORG).distinct()
    orphan_goals = gls.select(ORG).join(stg_orgs, ORG, "left_anti").agg(F.count(F.lit(1)).alias("goal_orphans"))
    orphan_act = act.select(ORG).join(gls.select(ORG), ORG, "left_anti").agg(F.count(F.lit(1)).alias("act_orphans"))
    zero = F.lit(0)
    names = [("staging.id_duplicates", "stg_dup"), ("staging.id_nulls", "stg_id_null"),
             ("staging.organization_id_nulls", "stg_org_null"), ("staging.timestamp_nulls", "stg_ts_null"),
             ("staging.first_activity_timestamp_nulls", "stg_first_null"),
             ("goals.organization_id_duplicates", "goal_dup"), ("goals.organization_id_nulls", "goal_org_null"),
             ("goals.flag_nulls", "goal_flag_null"),
             ("activation.organization_id_duplicates", "act_dup"),
             ("activation.organization_id_nulls", "act_org_null"),
             ("goals.organizations_missing_in_staging", "goal_orphans"),
             ("activation.organizations_missing_in_goals", "act_orphans")]
    return _checks(_figures(tables, nulls, *duplicates, orphan_goals, orphan_act), [_row(n, F.col(c), zero) for n, c in names])


def tables_not_empty(tables: TableSet) -> DataFrame:
    """Every table of the build has rows."""
    counts = _figures(tables, {f"_{name}": (name, "rows", _n_rows()) for name in tables.list_tables()})
    return _checks(counts, [_row(f"{name}_rows", F.col(f"_{name}"), None, F.col(f"_{name}") > 0)
                            for name in tables.list_tables()])


def check_goal_totals(tables: TableSet, goals: Sequence[GoalSpec]) -> DataFrame:
    """Per goal, organizations meeting it recomputed from the staging rows with the raw
    predicate (``SUM(CASE …) >= k``, or as many distinct details) equal the goals mart's total."""
    def reached(g: GoalSpec) -> Column:
        if g.distinct_details:
            found = reduce(lambda a, b: a + b, [
                F.max(F.when(g.predicate() & (F.col(DETAIL) == d), 1).otherwise(0)) for d in sorted(set(g.details))])
        else:
            found = F.sum(F.when(g.predicate(), 1).otherwise(0))
        return (found >= g.min_count).cast("int").alias(g.column)

    per_org = tables.table("staging").groupBy(ORG).agg(*[reached(g) for g in goals])
    recomputed = per_org.agg(*[F.sum(g.column).alias(f"r_{g.name}") for g in goals])
    mart = tables.table("goals").agg(*[F.sum(g.column).alias(f"m_{g.name}") for g in goals])
    return total_rows(recomputed, mart, goals)


def total_rows(recomputed: DataFrame, mart: DataFrame, goals: Sequence[GoalSpec]) -> DataFrame:
    """The rows of V11 from one row ``r_<goal>`` and one row ``m_<goal>``."""
    return _checks(_one_row(recomputed, mart), [
        _row(g.column, F.col(f"r_{g.name}"), F.col(f"m_{g.name}")) for g in goals])
