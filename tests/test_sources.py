"""CSV source (S1): header case, null tokens, NULL organization policy, strict timestamps."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from orgpulse.sources.csv import read_events_csv

CSV = """ORGANIZATION_ID,ACTIVITY_NAME,ACTIVITY_DETAIL,TIMESTAMP
org-1,Shift.Created,,2024-03-01 09:00:00
org-1,Page.Viewed,revenue,2024-03-01T09:00:00.900
NA,Hr.Employee.Invited,null,2024-03-04 12:00:00
,Page.Viewed,N/A,2024-03-04 12:00:01
org-2,None,availability,2024-03-05 00:00:00
"""


def _write(text):
    d = tempfile.mkdtemp(prefix="orgpulse-csv-")
    path = os.path.join(d, "events.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_read_cleans_values(spark):
    df = read_events_csv(spark, _write(CSV))
    assert df.columns == ["event_id", "organization_id", "activity_name", "activity_detail", "timestamp"]
    rows = df.orderBy("event_id").collect()
    assert [r.organization_id for r in rows] == ["org-1", "org-1", "nan", "nan", "org-2"]
    assert [r.activity_detail for r in rows] == [None, "revenue", None, None, "availability"]
    assert rows[4].activity_name is None
    assert str(rows[1].timestamp) == "2024-03-01 09:00:00.900000"
    assert len({r.event_id for r in rows}) == 5


def test_csv_null_org_policies(spark):
    keep = read_events_csv(spark, _write(CSV), null_org="keep")
    assert keep.filter("organization_id IS NULL").count() == 2
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_events_csv(spark, _write(CSV), null_org="reject").collect()


def test_csv_strict_timestamps(spark):
    bad = CSV + "org-3,Shift.Created,,not a time\n"
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_events_csv(spark, _write(bad)).collect()
    lenient = read_events_csv(spark, _write(bad), strict=False)
    assert lenient.filter("timestamp IS NULL").count() == 1


def test_csv_round_trip_keeps_microseconds(spark):
    from pyspark.sql import functions as F
    from orgpulse.session import scratch_path
    from orgpulse.sources.adapters import fixture_b
    from orgpulse.sources.csv import write_events_csv
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(f"{sf}/events.parquet"):
        pytest.skip("test data not present")
    ev = fixture_b(spark, sf).drop("event_id")
    path = scratch_path(spark, "csv-rt")
    write_events_csv(ev, path)
    back = read_events_csv(spark, path, with_event_id=False)
    assert back.exceptAll(ev).count() == 0 and ev.exceptAll(back).count() == 0
    assert back.filter(F.substring(F.date_format("timestamp", "SSSSSS"), 4, 3) != "000").count() > 0


def test_marts_cli_runs_every_check(spark, tmp_path, capsys):
    from orgpulse.plans.marts import main
    csv_path = _write(CSV)
    # one activity is missing, and no organization is activated: both are reported
    assert main(["--csv", csv_path, "--out", str(tmp_path / "marts")], spark=spark) == 1
    out = capsys.readouterr().out
    assert [line.split()[0] for line in out.splitlines() if "FAILED" in line] == ["null_activity_name", "activation_rows"]
    for name in ("raw_rows", "null_timestamp", "timestamp_range", "common_orgs", "non_atomic_values",
                 "goals.flag_nulls", "goal_shift_created"):
        assert f"\n{name} " in "\n" + out


@pytest.mark.parametrize("bound", [0, None], ids=["two-level", "single-task"])
def test_consecutive_ids(spark, monkeypatch, bound):
    import orgpulse.operators.common as common
    if bound is not None:
        monkeypatch.setattr(common, "SINGLE_TASK_ROWS", bound)
    df = read_events_csv(spark, _write(CSV), consecutive_ids=True)
    rows = df.orderBy("event_id").collect()
    assert [r.event_id for r in rows] == [1, 2, 3, 4, 5]
    assert [(r.organization_id, str(r.timestamp)) for r in rows] == sorted(
        (r.organization_id, str(r.timestamp)) for r in rows)
    from orgpulse.operators.common import consecutive_ids
    big = consecutive_ids(spark.range(0, 2500).select((F.col("id") * 7 % 2500).alias("k")), ["k"], "rid")
    assert big.filter(F.col("rid") != F.col("k") + 1).count() == 0


def test_csv_strict_without_ansi(spark):
    bad = CSV + "org-3,Shift.Created,,not a time\n"
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises((PySparkException, Py4JJavaError)):
            read_events_csv(spark, _write(bad)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_csv_columns_by_name(spark):
    text = ('timestamp,Extra,ACTIVITY_DETAIL,organization_id,ACTIVITY_NAME\n'
            '2024-01-01 00:00:00+05:00,e1,"a ""b""",org,"two\nlines"\n2024-01-01T10:00:00Z,,x,org,n\n')
    df = read_events_csv(spark, _write(text), multi_line=True, extra_columns=True).orderBy("event_id")
    assert df.columns == ["event_id", "organization_id", "activity_name", "activity_detail", "timestamp", "extra"]
    rows = [(r.organization_id, r.activity_name, r.activity_detail, str(r.timestamp), r.extra) for r in df.collect()]
    assert rows == [("org", "two\nlines", 'a "b"', "2023-12-31 19:00:00", "e1"), ("org", "n", "x", "2024-01-01 10:00:00", None)]


def test_csv_headers_are_checked(spark):
    with pytest.raises(ValueError, match="TIMESTAMP"):
        read_events_csv(spark, _write("ORGANIZATION_ID,ACTIVITY_NAME,ACTIVITY_DETAIL\na,b,c\n"))
    path = os.path.dirname(_write(CSV))
    with open(os.path.join(path, "other.csv"), "w") as f:
        f.write("ACTIVITY_NAME,ORGANIZATION_ID,ACTIVITY_DETAIL,TIMESTAMP\nn,o,d,2024-01-01 00:00:00\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="header"):
        read_events_csv(spark, path).collect()


def test_submitted_settings_are_kept():
    import subprocess
    import sys
    code = ("from orgpulse.session import build_session\nspark = build_session(master='local[8]', shuffle_partitions=8)\n"
            "print('GOT', spark.sparkContext.master, spark.conf.get('spark.sql.shuffle.partitions'))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=64 pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120).stdout
    assert "GOT local[2] 64" in out


def test_settings_of_spark_submit_are_kept(tmp_path):
    import subprocess
    import sys

    import pyspark
    script = tmp_path / "job.py"
    script.write_text("from orgpulse.session import build_session\nspark = build_session(master='local[8]', shuffle_partitions=8)\n"
                      "conf = spark.sparkContext.getConf()\n"
                      "print('GOT', spark.sparkContext.master, spark.conf.get('spark.sql.shuffle.partitions'),"
                      " conf.get('spark.driver.memory'), spark.conf.get('spark.sql.session.timeZone'))\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    submit = os.path.join(os.path.dirname(pyspark.__file__), "bin", "spark-submit")
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([submit, "--master", "local[3]", "--driver-memory", "1g", "--conf", "spark.sql.shuffle.partitions=5", str(script)],
                         env=env, capture_output=True, text=True, timeout=120)
    assert "GOT local[3] 5 1g UTC" in out.stdout, out.stderr[-2000:]


def test_a_plain_local_session_has_the_defaults():
    import subprocess
    import sys
    code = ("from orgpulse.session import build_session\nspark = build_session(master='local[2]', shuffle_partitions=3)\n"
            "print('GOT', spark.sparkContext.master, spark.conf.get('spark.sql.shuffle.partitions'),"
            " spark._jvm.Runtime.getRuntime().maxMemory() >> 30)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"PYTHONPATH": root}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "GOT local[2] 3 8" in out.stdout, out.stderr[-2000:]
