"""Sources and sinks: parquet tables, fixture adapters, the raw CSV export, table writes."""

from orgpulse.sources.adapters import (  # noqa: F401
    ORDER_GOALS, STREAM_GOALS, fixture_a, fixture_b, orders_as_events, stream_as_events,
)
from orgpulse.sources.csv import read_events_csv, write_events_csv  # noqa: F401
from orgpulse.sources.sinks import write_and_read, write_table  # noqa: F401
from orgpulse.sources.tables import TableSet, read_table  # noqa: F401
