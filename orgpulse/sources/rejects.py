"""Loading an export with its bad records set aside.

One pass reads the files, classifies every record, counts by reason (``DataFrame.observe``) and writes
accepted events and rejects side by side, as two partitions of one table.  Accepted and rejected records
together are the records read.  A limit on rejects fails the load, and nothing of it remains.

Reasons: ``columns`` (another number of values than the header; ``raw`` is the whole record),
``timestamp`` (unparsable; ``raw`` is its text) and, with ``null_org="reject"``, ``organization`` (missing;
``raw`` is NULL).  A missing timestamp is no error: the event is accepted with a NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orgpulse.functions.goals import DETAIL, EVENT_ID, NAME, ORG, TS
from orgpulse.session import delete_path, scratch_path
from orgpulse.sources.csv import _event_columns, read_text_columns

REASONS = ("columns", "timestamp", "organization")
_CORRUPT = "_corrupt_record"


class TooManyRejects(ValueError):
    """The limit on rejected records was exceeded; nothing was loaded."""


@dataclass
class CsvLoad:
    """``events`` and ``rejects`` as written, and the counts of the pass that wrote them."""

    events: DataFrame
    rejects: DataFrame
    rows_read: int
    rejected: dict[str, int]

    @property
    def accepted(self) -> int:
        return self.rows_read - sum(self.rejected.values())


def classified(spark: SparkSession, path: str, null_org: str = "nan", multi_line: bool = False) -> DataFrame:
    """Every record of the export: the event columns, ``reason`` (NULL: accepted), ``raw`` and ``file``."""
    raw, _ = read_text_columns(spark, path, multi_line, corrupt=_CORRUPT)
    org, name, detail, ts, bad_ts = _event_columns(null_org)
    broken = F.col(_CORRUPT).isNotNull()
    reason = F.when(broken, "columns").when(bad_ts, "timestamp")
    if null_org == "reject":
        reason = reason.when(org.isNull(), "organization")
    text = F.when(broken, F.col(_CORRUPT)).when(bad_ts, F.col("timestamp"))
    return raw.select(F.monotonically_increasing_id().alias(EVENT_ID), org.alias(ORG), name.alias(NAME), detail.alias(DETAIL),
                      ts.alias(TS), reason.alias("reason"), text.alias("raw"), F.col("_metadata.file_path").alias("file"))


def load_events_csv(spark: SparkSession, path: str, out_dir: str | None = None, null_org: str = "nan",
                    multi_line: bool = False, max_rejects: int | None = None,
                    max_reject_share: float | None = None) -> CsvLoad:
    """Load an export into ``out_dir`` (a new folder; by default under the shared folder)."""
    out = (out_dir or scratch_path(spark, "csv-load")).rstrip("/")
    seen = Observation()
    rows = classified(spark, path, null_org, multi_line).withColumn("rejected", F.col("reason").isNotNull()).observe(
        seen, F.count(F.lit(1)).alias("rows_read"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    rows.write.partitionBy("rejected").parquet(out)
    counts = seen.get
    written = spark.read.schema(rows.schema).parquet(out)
    load = CsvLoad(written.where("not rejected").select(EVENT_ID, ORG, NAME, DETAIL, TS),
                   written.where("rejected").select("reason", "raw", "file", ORG, NAME, DETAIL),
                   counts["rows_read"], {r: counts[r] for r in REASONS})
    if _exceeded(load, max_rejects, max_reject_share):
        # a task that ran twice is observed twice: the written rows decide
        counted = {r["reason"]: r["count"] for r in written.groupBy("reason").count().collect()}
        load.rows_read, load.rejected = sum(counted.values()), {r: counted.get(r, 0) for r in REASONS}
        if _exceeded(load, max_rejects, max_reject_share):
            delete_path(spark, out)
            raise TooManyRejects(f"{sum(load.rejected.values())} of {load.rows_read} records of {path} rejected: {load.rejected}")
    return load


def _exceeded(load: CsvLoad, most: int | None, share: float | None) -> bool:
    bad = sum(load.rejected.values())
    return (most is not None and bad > most) or (share is not None and bad > share * load.rows_read)
