"""The full build (the reference's ETL script, E1): raw → staging → goals → activation.

:func:`build_tables` returns the four tables as lazy DataFrames; :func:`write_marts` writes
them with full-refresh semantics (S2, S3) — all four replace the earlier ones at once — to a folder, by
default under the shared checkpoint folder, and continues from the written copies.  :func:`built` keeps one
build per input for any number of checks.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.functions.goals import EVENT_ID, ORG, TS, GoalSpec, all_met
from orgpulse.operators import quality
from orgpulse.operators.goals import fully_activated, goal_flags, org_goal_profile
from orgpulse.operators.staging import FIRST_TS, stage
from orgpulse.session import delete_path, drop_scratch, ensure_checkpoint_dir, scratch_path
from orgpulse.sources.csv import normalize_org
from orgpulse.sources.layout import KEYS, layout_of, salted_events, salted_orgs
from orgpulse.sources.tables import TableSet
from orgpulse.sources.versions import Build, ConcurrentBuild, VersionedTables

TABLE_ORDER = ("raw", "staging", "goals", "activation")


def raw_events(events: DataFrame, null_org: str = "nan") -> DataFrame:
    """S2 input: organization id as text with the NULL policy applied."""
    return events.withColumn(ORG, normalize_org(F.col(ORG), null_org))


def build_tables(events: DataFrame, goals: Sequence[GoalSpec], null_org: str = "nan") -> TableSet:
    raw = raw_events(events, null_org)
    flags = goal_flags(org_goal_profile(raw, goals), goals)
    return TableSet({"raw": raw, "staging": lambda: stage(raw), "goals": flags,
                     "activation": fully_activated(flags, goals)})


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _build(build: Build, events: DataFrame, goals: Sequence[GoalSpec], null_org: str) -> None:
    """Write the four tables; the counts that checks need are taken on the way."""
    null = lambda c: F.count_if(F.col(c).isNull())
    raw = build.write("raw", raw_events(events, null_org))
    build.write("staging", stage(raw), id_null=null(EVENT_ID), org_null=null(ORG), ts_null=null(TS), first_null=null(FIRST_TS),
                non_atomic=F.count_if(F.coalesce(quality.non_atomic(), F.lit(False))))
    flags = build.write("goals", goal_flags(org_goal_profile(raw, goals), goals), org_null=null(ORG),
                        flag_null=F.count_if(_any([F.col(g.column).isNull() for g in goals])))
    build.write("activation", fully_activated(flags, goals), org_null=null(ORG))


def write_marts(spark: SparkSession, events: DataFrame, goals: Sequence[GoalSpec],
                out_dir: str | None = None, null_org: str = "nan") -> TableSet:
    """Write raw, staging, goals and activation as a new version under ``out_dir`` (see
    :mod:`orgpulse.sources.versions`) and return the written tables.  Versions that this one replaces are
    removed unless a reader holds them."""
    store = VersionedTables(spark, out_dir or scratch_path(spark, "marts"))
    with store.build() as build:
        _build(build, events, goals, null_org)
    store.vacuum()
    return TableSet(dict(build.tables), build.stats)


#: Changes whenever builds of an earlier library must not be reused.
BUILD_FORMAT = 1


def build_key(events: DataFrame, goals: Sequence[GoalSpec], null_org: str) -> str | None:
    """Names a build by what it reads and computes: the plan of ``events``, the names, lengths and times of its
    files, the goals.  None for events that don't come from files (nothing tells whether they changed)."""
    spark, paths = events.sparkSession, events.inputFiles()
    if not paths:
        return None
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen: list[str] = []
    wanted = {}
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        wanted.setdefault(where.getParent().toString(), set()).add(where.getName())
    for parent, names in sorted(wanted.items()):
        folder = spark._jvm.org.apache.hadoop.fs.Path(parent)
        seen += sorted(f"{parent}/{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}"
                       for s in folder.getFileSystem(conf).listStatus(folder) if s.getPath().getName() in names)
    plan = events._jdf.queryExecution().analyzed().canonicalized().toString()
    return hashlib.sha256("\n".join([str(BUILD_FORMAT), null_org, repr(tuple(goals)), plan, *seen]).encode()).hexdigest()


def _shared_build(spark: SparkSession, key: str | None, build_all: Callable[[Build], None]) -> TableSet | None:
    """The build named ``key`` in the shared folder, made by ``build_all`` if nobody has yet."""
    if key is None:
        return None
    store = VersionedTables(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/orgpulse-builds/{key}")
    if store.current() is None:
        try:
            with store.build() as build:
                build_all(build)
        except ConcurrentBuild:  # the same tables, by another session
            pass
    with store.read() as tables:  # never replaced: a change of the input has another key
        return tables


def built(spark: SparkSession, events: DataFrame, goals: Sequence[GoalSpec], null_org: str = "nan") -> TableSet | None:
    """The marts of these events, built on first use and reused by later calls (also of other sessions that
    share the folder) until the input, the goals or the policy change.  None if the input can't be named."""
    return _shared_build(spark, build_key(events, goals, null_org), lambda build: _build(build, events, goals, null_org))


def _build_laid_out(build: Build, events: DataFrame, goals: Sequence[GoalSpec], null_org: str, buckets: int | None) -> None:
    raw = raw_events(events, null_org)
    layout = layout_of(raw, buckets)
    build.write_laid_out("events", salted_events(raw, layout), layout)
    flags = build.write_laid_out("goals", salted_orgs(goal_flags(org_goal_profile(raw, goals), goals), layout), layout)
    build.write_laid_out("activation", flags.where(all_met(goals)).select(*KEYS), layout)


def built_by_org(spark: SparkSession, events: DataFrame, goals: Sequence[GoalSpec], null_org: str = "nan",
                 buckets: int | None = None) -> TableSet:
    """Events, goals and activation laid out by organization (:mod:`orgpulse.sources.layout`), built once per input
    like :func:`built`.  Checks and metrics on them are in :mod:`orgpulse.operators.colocated`.  Events that don't come
    from files are built anew under a fresh folder."""
    key = build_key(events, goals, null_org)
    wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{key or uuid.uuid4().hex}-by-org-{wanted}"
    return _shared_build(spark, name, lambda build: _build_laid_out(build, events, goals, null_org, buckets))


def drop_builds(spark: SparkSession) -> None:
    """Delete all reusable builds."""
    delete_path(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/orgpulse-builds")


def checked(spark: SparkSession, events: DataFrame, goals: Sequence[GoalSpec],
            check: Callable[[TableSet], DataFrame], null_org: str = "nan") -> DataFrame:
    """Run ``check`` on the written marts of ``events``: on their one build (:func:`built`), or, for events that
    can't be named, on one that is deleted afterwards (the result is the check's few rows)."""
    tables = built(spark, events, goals, null_org)
    if tables is not None:
        return check(tables)
    base = scratch_path(spark, "marts")
    try:
        rows = check(write_marts(spark, events, goals, base, null_org))
        return spark.createDataFrame(rows.collect(), rows.schema)
    finally:
        drop_scratch(spark, base)


def all_checks(tables: TableSet, goals: Sequence[GoalSpec]) -> list[DataFrame]:
    """Every check of the build (V1-V11) on its written tables."""
    staging = tables.table("staging")
    return [quality.table_counts(tables), quality.check_nulls(staging), quality.check_time_range(staging),
            quality.check_org_coverage(tables), quality.org_intersection(tables), quality.check_atomic_values(tables),
            quality.check_flag_domain(tables.table("goals"), goals), quality.check_constraints(tables, goals),
            quality.tables_not_empty(tables), quality.check_goal_totals(tables, goals)]


def main(argv: list[str] | None = None, spark=None) -> int:
    """Build the marts from a raw CSV export, run every check on them and print the results.

        python -m orgpulse.plans.marts --csv events.csv --out /shared/marts
    """
    import argparse

    from orgpulse.functions.goals import REFERENCE_GOALS
    from orgpulse.session import build_session
    from orgpulse.sources.csv import read_events_csv

    ap = argparse.ArgumentParser(description=main.__doc__)
    ap.add_argument("--csv", required=True, help="raw export (file, folder or glob)")
    ap.add_argument("--out", required=True, help="folder for raw, staging, goals, activation")
    ap.add_argument("--null-org", default="nan", choices=["nan", "keep", "reject"])
    ap.add_argument("--multi-line", action="store_true", help="quoted values may hold line feeds")
    args = ap.parse_args(argv)

    own = spark is None
    spark = spark or build_session()
    events = read_events_csv(spark, args.csv, null_org=args.null_org, multi_line=args.multi_line)
    tables = write_marts(spark, events, REFERENCE_GOALS, args.out, null_org=args.null_org)
    failed = 0
    for check in all_checks(tables, REFERENCE_GOALS):
        for r in check.collect():
            failed += not r.passed
            values = ", ".join(f"{k} {v}" for k, v in r.asDict().items() if k not in ("check", "passed"))
            print(f"{r.check:48s} {'ok' if r.passed else 'FAILED'}  {values}")
    if own:
        spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
