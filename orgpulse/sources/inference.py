"""Types of CSV columns (S1), inferred over all rows in one pass.

Each value has a class: missing (the null tokens), ``bool`` (true/false in any case), ``int`` (fits 64
bits), ``float`` (with exponent, ``inf``; finite in double precision), ``timestamp`` (ISO date, or date and
time) or ``text``.  Classes form a lattice: int widens to float; any other two classes widen to text; missing
values fit every type.  As with a reader that infers from whole columns, one value at the end decides.

The state of a column is mergeable: the count of missing values and, per class, the first position it is
seen at.  It is folded per input split (``_metadata`` names the file and where the split begins) in one
aggregate with map-side combining; the number of rows in the splits before, in order of file name and offset,
turns positions within a split into row numbers, so the result doesn't depend on how the files were split.

Integers with missing values stay integers (a nullable type needs no change to float).  Integers beyond 64
bits are text.  Timestamps are a class of their own where a plain inference would leave text.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.operators.common import running_totals
from orgpulse.session import materialize
from orgpulse.sources.csv import PANDAS_NA_TOKENS, read_text_columns

CLASSES = ("bool", "int", "float", "timestamp", "text")

_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITY = r"^[+-]?(inf|infinity)$"
_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"
_NEVER = (1 << 62)


def value_class(c: Column) -> Column:
    """The class of a text value; NULL for a missing one."""
    number = F.trim(c)
    return (F.when(c.isNull() | c.isin(list(PANDAS_NA_TOKENS)), None)
            .when(F.lower(c).isin("true", "false"), "bool")
            .when(F.regexp(number, F.lit(_INT)), F.when(number.try_cast("bigint").isNotNull(), "int").otherwise("text"))
            .when(F.regexp(number, F.lit(_FLOAT)), F.when(F.abs(number.try_cast("double")) < float("inf"), "float").otherwise("text"))
            .when(F.regexp(F.lower(number), F.lit(_INFINITY)), "float")
            .when(F.regexp(number, F.lit(_TIMESTAMP)) & number.try_cast("timestamp_ntz").isNotNull(), "timestamp")
            .otherwise("text"))


def infer_types(texts: DataFrame, columns: list[str], file: Column, offset: Column) -> DataFrame:
    """Fold the state of ``columns`` over all rows of ``texts``; ``file`` and ``offset`` name the split a row
    comes from.  One row per column, in their order: column, type (``null`` if every value is missing), nulls,
    first_row (1-based number of the row from which on the column has its type; NULL for type null)."""
    place = F.monotonically_increasing_id()  # consecutive within a split, whatever the partition
    seen = texts.select(file.alias("file"), offset.alias("offset"), place.alias("place"),
                        *[value_class(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(columns)])
    first = [F.min(F.when(F.col(f"c{k}") == kind, F.col("place"))).alias(f"{kind}{k}")
             for k in range(len(columns)) for kind in CLASSES]
    nulls = [F.count_if(F.col(f"c{k}").isNull()).alias(f"nulls{k}") for k in range(len(columns))]
    # one row per split, written: the files are read once
    splits = materialize(seen.groupBy("file", "offset").agg(
        F.count(F.lit(1)).alias("rows"), F.min("place").alias("start"), *first, *nulls), "csv-splits")
    numbered = running_totals(splits, by=[], order=["file", "offset"], sums=["rows"])
    row = lambda c: F.col("cum_rows") - F.col("rows") + F.col(c) - F.col("start") + 1
    whole = numbered.agg(*[F.coalesce(F.min(row(f"{kind}{k}")), F.lit(_NEVER)).alias(f"{kind}{k}")
                           for k in range(len(columns)) for kind in CLASSES],
                         *[F.coalesce(F.sum(f"nulls{k}"), F.lit(0)).alias(f"nulls{k}") for k in range(len(columns))])

    def result(k: int, name: str) -> Column:
        at = {kind: F.col(f"{kind}{k}") for kind in CLASSES}
        clashes = [F.greatest(at[a], at[b]) for a, b in combinations(CLASSES[:-1], 2) if {a, b} != {"int", "float"}]
        text = reduce(F.least, clashes, at["text"])
        found = F.when(text < _NEVER, F.struct(F.lit("text").alias("type"), text.alias("first_row")))
        for kind in ("float", "int", "bool", "timestamp"):
            found = found.when(at[kind] < _NEVER, F.struct(F.lit(kind).alias("type"), at[kind].alias("first_row")))
        found = found.otherwise(F.struct(F.lit("null").alias("type"), F.lit(None).cast("bigint").alias("first_row")))
        return F.struct(F.lit(name).alias("column"), found["type"].alias("type"), F.col(f"nulls{k}").alias("nulls"),
                        found["first_row"].alias("first_row"))

    return whole.select(F.inline(F.array(*[result(k, c) for k, c in enumerate(columns)])))


def infer_csv_schema(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """:func:`infer_types` for every column of a raw export (lower-case names)."""
    raw, header = read_text_columns(spark, path, multi_line)
    return infer_types(raw, header, F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))


def inferred_types(schema: DataFrame) -> dict[str, str]:
    """Type names by column (the driver holds one row per column)."""
    return {r.column: r.type for r in schema.collect()}
