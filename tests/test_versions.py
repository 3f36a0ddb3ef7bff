"""Table sets replaced as a whole, and builds that many checks share."""

import os

import pytest
from pyspark.sql import functions as F

from orgpulse.functions.goals import REFERENCE_GOALS
from orgpulse.operators import quality as Q
from orgpulse.plans import marts
from orgpulse.plans.marts import TABLE_ORDER, all_checks, built, write_marts
from orgpulse.sources.tables import TableSet
from orgpulse.sources.versions import Build, ConcurrentBuild, VersionedTables


def counts(tables):
    return {n: tables.table(n).count() for n in tables.list_tables()}


@pytest.mark.parametrize("done", range(5))
def test_a_build_that_stops_midway_is_never_seen(spark, raw_c, tmp_path, monkeypatch, done):
    root = str(tmp_path / "marts")
    old = counts(write_marts(spark, raw_c, REFERENCE_GOALS, root))
    assert old == {"raw": 14, "staging": 14, "goals": 4, "activation": 1}
    plain, calls = Build.write, []

    def write(self, name, df, **counted):
        if len(calls) == done:
            raise OSError("disk gone")
        calls.append(name)
        return plain(self, name, df, **counted)

    monkeypatch.setattr(Build, "write", write)
    more = raw_c.union(raw_c.withColumn("event_id", F.col("event_id") + 100))
    if done < 4:
        with pytest.raises(OSError):
            write_marts(spark, more, REFERENCE_GOALS, root)
    else:  # all four written, not published yet
        monkeypatch.setattr(marts, "_build", lambda b, *a, f=marts._build: (f(b, *a), (_ for _ in ()).throw(OSError("late")))[0])
        with pytest.raises(OSError):
            write_marts(spark, more, REFERENCE_GOALS, root)
    assert calls == list(TABLE_ORDER)[:done]
    store = VersionedTables(spark, root)
    with store.read() as tables:
        assert counts(tables) == old and tables.list_tables() == list(TABLE_ORDER)
    assert len(os.listdir(f"{root}/versions")) == 1 and not [n for n in os.listdir(f"{root}/_holds") if not n.startswith(".")]
    monkeypatch.undo()
    write_marts(spark, more, REFERENCE_GOALS, root)
    with store.read() as tables:
        assert counts(tables)["raw"] == tables.stats["raw"]["rows"] == 28


def test_a_held_version_outlives_its_successors(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "set"))
    with pytest.raises(FileNotFoundError):
        store.read()
    for n in (3, 5, 8):
        with store.build() as b:
            b.write("t", spark.range(n), odd=F.count_if(F.col("id") % 2 == 1))
        if n == 3:
            held = store.read()
        elif n == 5:
            other = store.read()
    assert held.tables.stats["t"] == {"rows": 3, "odd": 1}
    assert store.vacuum() == [] and counts(held.tables) == {"t": 3} and counts(other.tables) == {"t": 5}
    held.release()
    assert store.vacuum() == [held.folder] and counts(other.tables) == {"t": 5}
    assert store.vacuum(hold_seconds=-1) == [other.folder]  # its process is taken for dead
    with store.read() as tables:
        assert counts(tables) == {"t": 8}


def test_of_two_builds_one_is_published(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "set"))
    with pytest.raises(ConcurrentBuild):
        with store.build() as slow:
            slow.write("t", spark.range(1))
            with store.build() as fast:
                fast.write("t", spark.range(2))
            assert store.vacuum() == []  # a build under way is not litter
    with store.read() as tables:
        assert counts(tables) == {"t": 2}
    assert len(os.listdir(tmp_path / "set" / "versions")) == 1


def test_counted_figures_equal_scanned_ones(spark, raw_c):
    broken = raw_c.withColumn("event_id", F.when(F.col("event_id") > 2, F.col("event_id"))).withColumn(
        "organization_id", F.when(F.col("event_id") != 9, F.col("organization_id")))
    for events in (raw_c, broken, raw_c.where("false")):
        tables = write_marts(spark, events, REFERENCE_GOALS, null_org="keep")
        assert tables.stats and all("rows" in s for s in tables.stats.values())
        plain = TableSet({n: tables.table(n) for n in TABLE_ORDER})
        for a, b in zip(all_checks(tables, REFERENCE_GOALS), all_checks(plain, REFERENCE_GOALS)):
            assert a.collect() == b.collect()


def test_checks_share_one_build(spark, raw_c, tmp_path):
    path = str(tmp_path / "events")
    raw_c.write.parquet(path)
    events = spark.read.parquet(path)
    writes = []
    plain = Build.write
    Build.write = lambda self, name, df, **c: (writes.append(name), plain(self, name, df, **c))[1]
    try:
        for check in (Q.table_counts, Q.check_org_coverage, Q.org_intersection, Q.tables_not_empty, Q.check_atomic_values):
            marts.checked(spark, spark.read.parquet(path), REFERENCE_GOALS, check).collect()
        assert writes == list(TABLE_ORDER)
        assert built(spark, raw_c, REFERENCE_GOALS) is None  # rows of the driver: nothing names them
        marts.checked(spark, events, REFERENCE_GOALS[:3], Q.tables_not_empty).collect()
        marts.checked(spark, events, REFERENCE_GOALS, Q.tables_not_empty, null_org="keep").collect()
        assert len(writes) == 12
        raw_c.limit(5).write.mode("append").parquet(path)  # the input changed
        rows = marts.checked(spark, spark.read.parquet(path), REFERENCE_GOALS, Q.tables_not_empty).collect()
        assert len(writes) == 16 and rows[0].observed == 19
    finally:
        Build.write = plain
    marts.drop_builds(spark)
    assert counts(built(spark, spark.read.parquet(path), REFERENCE_GOALS))["raw"] == 19


def test_figures_of_the_build_need_no_scan(spark, raw_c):
    tables = write_marts(spark, raw_c, REFERENCE_GOALS)
    plan = Q.tables_not_empty(tables)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "FileScan" not in plan
