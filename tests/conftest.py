import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from orgpulse.session import ensure_checkpoint_dir  # noqa: E402

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("organization_id", T.StringType()),
    T.StructField("activity_name", T.StringType()),
    T.StructField("activity_detail", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


# Hand-made edge fixture C (FIXTURES.md §4); the organization of events 13 and 14 is NULL.
FIXTURE_C_ROWS = [
    (1, "A", "Shift.Created", None, ts("2024-03-01 09:00:00")),
    (2, "A", "Shift.Created", None, ts("2024-03-01 09:00:00")),
    (3, "A", "Hr.Employee.Invited", None, ts("2024-03-01 09:01:00")),
    (4, "A", "PunchClock.PunchedIn", None, ts("2024-03-02 09:00:00")),
    (5, "A", "PunchClock.Approvals.EntryApproved", None, ts("2024-03-02 10:00:00")),
    (6, "A", "Page.Viewed", "revenue", ts("2024-03-03 09:00:00")),
    (7, "A", "Page.Viewed", "revenue", ts("2024-03-03 09:00:00.900000")),
    (8, "A", "Page.Viewed", "availability", ts("2024-03-05 09:00:00")),
    (9, "B", "Page.Viewed", None, ts("2024-03-01 00:00:00")),
    (10, "C", "Shift.Created", None, ts("2024-03-01 08:00:00.900000")),
    (11, "C", "Page.Viewed", "revenue", ts("2024-03-01 08:00:02.100000")),
    (12, "C", "Page.Viewed", "revenue", ts("2024-03-01 08:00:03.900000")),
    (13, None, "Hr.Employee.Invited", None, ts("2024-03-04 12:00:00")),
    (14, None, "Odd;name", None, ts("2024-03-04 12:00:01")),
]


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[*]")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_c(spark):
    """Fixture C as loaded, NULL organizations still NULL."""
    return spark.createDataFrame(FIXTURE_C_ROWS, EVENT_SCHEMA)


@pytest.fixture(scope="session")
def events_c(raw_c):
    """Fixture C after the raw load: NULL organization → 'nan' (T5)."""
    from orgpulse.plans.marts import raw_events
    return raw_events(raw_c)
