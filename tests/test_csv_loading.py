"""Inferred types of CSV columns, and loads with rejects set aside."""

import io
import os

import pandas as pd
import pytest

from orgpulse.sources import read_events_csv
from orgpulse.sources.inference import infer_csv_schema
from orgpulse.sources.rejects import TooManyRejects, load_events_csv

HEADER = "ORGANIZATION_ID,ACTIVITY_NAME,ACTIVITY_DETAIL,TIMESTAMP,Extra"


def export(folder, values, files=1):
    """Rows with these extra values, in ``files`` files of equal length."""
    os.makedirs(folder)
    step = -(-len(values) // files)
    for k in range(files):
        lines = [f"{i},Page.Viewed,detail {i},2024-03-01 10:00:{i % 60:02d},{v}" for i, v in enumerate(values[k * step:(k + 1) * step])]
        with open(f"{folder}/part-{k:03d}.csv", "w") as f:
            f.write("\n".join([HEADER, *lines, ""]))
    return str(folder)


def found(spark, path):
    return {r.column: (r.type, r.nulls, r.first_row) for r in infer_csv_schema(spark, path).collect()}


@pytest.mark.parametrize("values, expected", [
    (["1", " 2 ", "+3", "-4", "00012"], ("int", 0, 1)),
    (["1", "NA", "2.5", "3"], ("float", 1, 3)),
    (["", "null", "7"], ("int", 2, 3)),
    (["", "null", "n/a"], ("null", 3, None)),
    (["True", "FALSE", "tRue", ""], ("bool", 1, 1)),
    (["True", "NA", "1", "x"], ("text", 1, 3)),
    (["1", "true"], ("text", 0, 2)),
    (["1.5", "2024-01-01"], ("text", 0, 2)),
    (["2024-01-01", "2024-01-01 10:11", "2024-01-01T10:11:12.123456"], ("timestamp", 0, 1)),
    (["2024-01-01", "2024-13-01"], ("text", 0, 2)),
    ([".5", "1.", "1e5", "-Infinity", "INF"], ("float", 0, 1)),
    (["1", "1e400"], ("text", 0, 2)),
    (["9223372036854775807", "99999999999999999999"], ("text", 0, 2)),
    (["1", "0x10"], ("text", 0, 2)),
    (["-"], ("text", 0, 1)),
])
def test_types_of_small_columns(spark, tmp_path, values, expected):
    path = export(tmp_path / "csv", values)
    assert found(spark, path)["extra"] == expected
    # a reader that infers from whole columns agrees on numbers, booleans and text
    kind = pd.read_csv(io.StringIO("a,b\n" + "".join(f"{v},0\n" for v in values))).a.dtype.kind
    if expected[0] in ("int", "float", "text") or expected[1] == 0 and expected[0] == "bool":
        assert {"int": "if", "float": "f", "text": "O", "bool": "b"}[expected[0]].find(kind) >= 0


def test_the_last_row_decides_and_splits_do_not_matter(spark, tmp_path):
    values = [str(i % 977) for i in range(6000)] + ["2.5"] + [str(i) for i in range(2998)] + ["end"]
    path = export(tmp_path / "csv", values, files=3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        results, parts = [], []
        for size in ("128m", "9000", "700000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            parts.append(spark.read.csv(path).rdd.getNumPartitions())
            results.append(found(spark, path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert max(parts) >= 50 and min(parts) <= 8
    assert results[0] == results[1] == results[2]
    assert results[0]["extra"] == ("text", 0, 9000) and results[0]["organization_id"] == ("int", 0, 1)
    assert results[0]["timestamp"] == ("timestamp", 0, 1) and results[0]["activity_detail"] == ("text", 0, 1)


def test_two_level_row_numbers(spark, tmp_path):
    path = export(tmp_path / "csv", ["1"] * 500 + ["1.5"] * 500, files=4)
    spark.conf.set("spark.orgpulse.singleTaskRows", "0")
    try:
        assert found(spark, path)["extra"] == ("float", 0, 501)
    finally:
        spark.conf.unset("spark.orgpulse.singleTaskRows")


def test_an_export_without_rows(spark, tmp_path):
    path = export(tmp_path / "csv", [])
    assert set(found(spark, path).values()) == {("null", 0, None)}
    assert read_events_csv(spark, path, extra_columns="infer").collect() == []


def test_extra_columns_in_inferred_types(spark, tmp_path):
    path = export(tmp_path / "csv", ["1", "NA", " 3"])
    events = read_events_csv(spark, path, extra_columns="infer")
    assert dict(events.dtypes)["extra"] == "bigint" and sorted((r.extra for r in events.collect()), key=str) == [1, 3, None]
    assert dict(read_events_csv(spark, path, extra_columns={"extra": "float"}).dtypes)["extra"] == "double"
    assert dict(read_events_csv(spark, path, extra_columns=True).dtypes)["extra"] == "string"


def bad_export(folder):
    os.makedirs(folder)
    with open(f"{folder}/a.csv", "w") as f:
        f.write(HEADER + "\n1,A,d,2024-03-01 10:00:00,x\n2,B,d,not a time,x\n3,C,d,NA,x\n,D,d,2024-03-01,x\n")
    with open(f"{folder}/b.csv", "w") as f:
        f.write(HEADER + "\n5,E,d\n6,F,d,2024-03-02T01:02:03Z,x,too,many\n7,G,\"d, e\",2024-03-01 00:00:01,x\n8,H,d,2024-02-30,x\n")
    return str(folder)


def test_rejects_are_set_aside_and_counted(spark, tmp_path):
    load = load_events_csv(spark, bad_export(tmp_path / "csv"))
    assert (load.rows_read, load.accepted, load.rejected) == (8, 4, {"columns": 2, "timestamp": 2, "organization": 0})
    events = {r.activity_name: r for r in load.events.collect()}
    assert sorted(events) == ["A", "C", "D", "G"] and events["C"].timestamp is None and events["D"].organization_id == "nan"
    assert events["G"].activity_detail == "d, e" and len({r.event_id for r in events.values()}) == 4
    rejects = sorted((r.reason, r.raw, os.path.basename(r.file)) for r in load.rejects.collect())
    assert rejects == [("columns", "5,E,d", "b.csv"), ("columns", "6,F,d,2024-03-02T01:02:03Z,x,too,many", "b.csv"),
                       ("timestamp", "2024-02-30", "b.csv"), ("timestamp", "not a time", "a.csv")]
    for side in (load.events, load.rejects):  # both sides are read from what one pass wrote
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "parquet" in plan.lower() and "csv" not in plan.lower().replace("csv-load", "").replace("a.csv", "")


def test_a_missing_organization_can_be_a_reason(spark, tmp_path):
    load = load_events_csv(spark, bad_export(tmp_path / "csv"), null_org="reject")
    assert load.rejected == {"columns": 2, "timestamp": 2, "organization": 1} and load.accepted == 3


def test_too_many_rejects_fail_the_load_and_leave_nothing(spark, tmp_path):
    path = bad_export(tmp_path / "csv")
    for limit in ({"max_rejects": 3}, {"max_reject_share": 0.4}):
        with pytest.raises(TooManyRejects, match="4 of 8"):
            load_events_csv(spark, path, out_dir=str(tmp_path / "out"), **limit)
        assert not (tmp_path / "out").exists()
    assert load_events_csv(spark, path, out_dir=str(tmp_path / "out"), max_rejects=4, max_reject_share=0.5).accepted == 4


def test_a_load_of_nothing(spark, tmp_path):
    load = load_events_csv(spark, export(tmp_path / "csv", []), max_rejects=0, max_reject_share=0.0)
    assert (load.rows_read, load.accepted) == (0, 0) and load.events.collect() == load.rejects.collect() == []
