"""CSV event source (S1) and the raw-table load (S2 input side).

The raw export has a header that names (at least) ``ORGANIZATION_ID``, ``ACTIVITY_NAME``,
``ACTIVITY_DETAIL`` and ``TIMESTAMP``, in any order.  Columns are read as strings, by name (types of
extra columns are inferred only on demand), then cleaned with column expressions:

* names are lower-cased so output schemas are stable (T17);
* the null spellings pandas recognises by default become SQL NULL (T6);
* the timestamp is parsed strictly (a bad value fails the job, as ``pd.to_datetime`` does),
  or leniently with ``strict=False`` (bad values become NULL); :mod:`orgpulse.sources.rejects` loads an
  export with bad records set aside and counted;
* a NULL organization becomes the text ``'nan'`` by default (T5), or is kept / rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.functions.goals import DETAIL, EVENT_ID, NAME, ORG, TS

# The strings pandas' CSV reader treats as missing by default.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

RAW_CSV_COLUMNS = ("ORGANIZATION_ID", "ACTIVITY_NAME", "ACTIVITY_DETAIL", "TIMESTAMP")

# A zone offset or Z at the end of a timestamp.
_ZONE = r"(?i)(z|[+-]\d{2}(:?\d{2})?)$"


def _header(spark: SparkSession, path: str, options: dict) -> list[str]:
    """The column names in the header of the export's first file (one line is read).  The read checks
    the header of every other file against them."""
    names = spark.read.options(**options).option("header", True).csv(path).columns
    lower = [n.strip().lower() for n in names]
    missing = [c for c in RAW_CSV_COLUMNS if c.lower() not in lower]
    if missing:
        raise ValueError(f"columns {missing} missing in the header of {path}: {names}")
    return names


def read_text_columns(spark: SparkSession, path: str, multi_line: bool = False,
                      corrupt: str | None = None) -> tuple[DataFrame, list[str]]:
    """(the export with every column as text under its lower-case name, those names).  A record with another
    number of values fails the read, or, with ``corrupt``, is kept as it stands in a column of that name."""
    options = {"quote": '"', "escape": '"', "multiLine": str(multi_line).lower()}
    header = _header(spark, path, options)
    fields = [T.StructField(n, T.StringType()) for n in header]
    reader = spark.read.options(**options).option("header", True).option("enforceSchema", False)
    if corrupt is None:
        reader = reader.option("mode", "FAILFAST")
    else:
        fields.append(T.StructField(corrupt, T.StringType()))
        # without pruning: the reader counts a record's values only if it parses all of them
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False)
    header = [n.strip().lower() for n in header]
    raw = reader.schema(T.StructType(fields)).csv(path)
    return raw.withColumnsRenamed({f.name: n for f, n in zip(fields, header)}), header


def _event_columns(null_org: str) -> tuple[Column, Column, Column, Column, Column]:
    """Organization, activity, detail and timestamp of a text row, and whether the timestamp is unparsable."""
    ts_text = F.trim(_na_to_null(F.col("timestamp")))
    # with a zone offset the instant is taken, as UTC; without one the value is as written
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts_text.try_cast("timestamp").cast("timestamp_ntz"))
    ts = F.when(F.regexp(ts_text, F.lit(_ZONE)) & F.contains(ts_text, F.lit(":")), zoned).otherwise(
        ts_text.try_cast("timestamp_ntz"))
    org = normalize_org(_na_to_null(F.col("organization_id")), null_org)
    return org, _na_to_null(F.col("activity_name")), _na_to_null(F.col("activity_detail")), ts, ts_text.isNotNull() & ts.isNull()


#: Column types by the names that schema inference uses.
TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "timestamp": "timestamp_ntz", "text": "string", "null": "string"}


def typed(c: Column, kind: str) -> Column:
    """A text value as one of the TYPES; missing values, and values that are none of the type, are NULL."""
    value = _na_to_null(c)
    return value if kind in ("text", "null") else F.trim(value).try_cast(TYPES[kind])


def _na_to_null(c: Column) -> Column:
    return F.when(c.isin(list(PANDAS_NA_TOKENS)), F.lit(None).cast("string")).otherwise(c)


def normalize_org(c: Column, null_org: str = "nan") -> Column:
    """Organization id as text; NULL → 'nan' (parity), kept as NULL, or rejected later."""
    c = c.cast("string")
    if null_org == "nan":
        return F.coalesce(c, F.lit("nan"))
    if null_org in ("keep", "reject"):
        return c
    raise ValueError(f"null_org must be 'nan', 'keep' or 'reject', not {null_org!r}")


def read_events_csv(spark: SparkSession, path: str, null_org: str = "nan", strict: bool = True,
                    with_event_id: bool = True, consecutive_ids: bool = False, multi_line: bool = False,
                    extra_columns: bool | str | dict[str, str] = False) -> DataFrame:
    """Read the raw export.  Columns are found by name in the header, whatever their order and case;
    ``extra_columns`` keeps those the event schema does not name at the end: ``True`` as text, ``"infer"``
    with the types that :func:`orgpulse.sources.inference.infer_csv_schema` finds over all rows (one more
    pass), or a dict of such types by lower-case name.  Values may be
    quoted, with ``""`` for a quote; ``multi_line`` allows line feeds inside quotes (such files are not
    split between tasks).  ``event_id`` is unique and increasing in file order; with
    ``consecutive_ids`` it is renumbered 1..n in (organization, timestamp, file order), like an
    auto-increment key filled from the organization-ordered staging insert."""
    raw, header = read_text_columns(spark, path, multi_line)
    org, name, detail, ts, bad_ts = _event_columns(null_org)
    if strict:  # fail the job on an unparsable value, whatever the session's ANSI setting
        ts = F.when(bad_ts, F.raise_error(F.concat(F.lit("unparsable TIMESTAMP in CSV: "), F.trim(F.col("timestamp"))))).otherwise(ts)
    if null_org == "reject":
        org = F.when(org.isNull(), F.raise_error(F.lit("NULL ORGANIZATION_ID in CSV"))).otherwise(org)
    cols = [org.alias(ORG), name.alias(NAME), detail.alias(DETAIL), ts.cast("timestamp_ntz").alias(TS)]
    if extra_columns:
        known = {c.lower() for c in RAW_CSV_COLUMNS} | {EVENT_ID}
        types: dict[str, str] = {}
        if extra_columns == "infer":
            from orgpulse.sources.inference import infer_csv_schema, inferred_types
            types = inferred_types(infer_csv_schema(spark, path, multi_line))
        elif isinstance(extra_columns, dict):
            types = extra_columns
        cols += [typed(F.col(f"`{n}`"), types.get(n, "text")).alias(n) for n in header if n not in known]
    if with_event_id:
        # Unique and increasing in file order; materialise (write the raw table) before reuse.
        cols.insert(0, F.monotonically_increasing_id().alias(EVENT_ID))
    df = raw.select(*cols)
    if with_event_id and consecutive_ids:
        from orgpulse.operators.common import consecutive_ids as renumber
        df = renumber(df.withColumnRenamed(EVENT_ID, "_file_pos"), [ORG, TS, "_file_pos"]).drop("_file_pos")
        df = df.select(EVENT_ID, *[c for c in df.columns if c != EVENT_ID])
    return df


def write_events_csv(events: DataFrame, path: str) -> None:
    """Export events in the raw CSV layout (upper-case header, microsecond timestamps)."""
    (events.select(F.col(ORG).alias("ORGANIZATION_ID"), F.col(NAME).alias("ACTIVITY_NAME"),
                   F.col(DETAIL).alias("ACTIVITY_DETAIL"), F.col(TS).alias("TIMESTAMP"))
     .write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option("quote", '"').option("escape", '"')
     .csv(path))
