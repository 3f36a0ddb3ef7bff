"""Distribution helpers shared by the operators.

* :func:`broadcast_if_small` — broadcast a join side only after its rows and bytes are measured
  against explicit bounds; above them the join stays a shuffle join (AQE may still split
  skewed partitions).
* :func:`running_totals` — exact running sums over a sorted key without funnelling a group
  into one task: range-partition, per-partition totals, a small offset table, local windows.
* :func:`unpivot_structs` — wide one-row aggregates to long ``(name, …)`` rows.
"""

from __future__ import annotations

import weakref
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgpulse.session import materialize

# Bounds of a broadcast side.  A session can override them with the settings
# ``spark.orgpulse.broadcastRows`` and ``spark.orgpulse.broadcastBytes`` (0 rows forces the
# shuffle-join path, used to check that path on small data).
DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def _setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"spark.orgpulse.{name}", str(default)))


def _unpersist(jdf) -> None:
    try:
        jdf.unpersist(False)
    except Exception:  # the session has ended, and its cache with it
        pass


def holding(result: DataFrame, *sides: DataFrame) -> DataFrame:
    """``result``, keeping the cached join ``sides`` it reads for as long as it is referenced."""
    result._orgpulse_sides = sides
    return result


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, int]:
    """Cache ``df`` (a per-organization aggregate or similar), measure it, and mark it for broadcast
    only if it has at most ``max_rows`` rows (default :data:`DEFAULT_BROADCAST_ROWS`) and
    :data:`DEFAULT_BROADCAST_BYTES` bytes of values, else for a sort-merge join.

    The side is computed once (the measuring fills the cache, the join reads it).  Its lineage is
    deterministic, so partitions lost with an executor, or dropped from the cache, are recomputed to
    the same rows.  The cache is released when the returned frame, and the result that
    :func:`holding` ties it to, are no longer referenced."""
    spark = df.sparkSession
    most = _setting(spark, "broadcastRows", DEFAULT_BROADCAST_ROWS) if max_rows is None else max_rows
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    weakref.finalize(df, _unpersist, df._jdf).atexit = False
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if t in ("string", "binary") else F.lit(8)
                 for c, t in df.dtypes), F.lit(0).cast("bigint"))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    small = n <= most and size <= _setting(spark, "broadcastBytes", DEFAULT_BROADCAST_BYTES)
    # Above the bounds a sort-merge join is pinned (Spark's own file-size rule could still pick
    # a broadcast); AQE then splits a skewed key's partition across tasks.
    return holding(F.broadcast(df) if small else df.hint("merge"), df), n


# Rows one window task may hold when a running total is computed per group in one task.
# The setting ``spark.orgpulse.singleTaskRows`` overrides it; 0 forces the two-level path.
SINGLE_TASK_ROWS = 2_000_000


def single_task_rows(spark: SparkSession) -> int:
    return _setting(spark, "singleTaskRows", SINGLE_TASK_ROWS)


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows in the largest ``by`` group (one small aggregate; the driver gets one number)."""
    sizes = df.groupBy(*by).count() if by else df.select(F.count(F.lit(1)).alias("count"))
    return sizes.agg(F.max("count")).first()[0] or 0


def running_totals(df: DataFrame, by: list[str], order: list[str], sums: list[str],
                   parts: int | None = None, single_task_rows: int | None = None, largest: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows of the same ``by`` group up to and including
    the current row in ``order`` (order keys must be unique within a group).

    The largest group is measured first (a caller that already measured it passes
    ``largest``): when it has at most ``single_task_rows`` rows (default
    :data:`SINGLE_TASK_ROWS`) a plain window per group is used, so each task holds at most that
    many rows.  Otherwise (or with ``single_task_rows=0``) a two-level prefix sum runs: rows are
    range-partitioned on ``by + order`` (balanced by sampling), each partition computes local
    running sums, and a table of per-partition totals (at most ``parts`` + groups rows)
    supplies each partition's offset.  The partition id is read once and frozen in a table
    written to the shared folder, so a recomputation (lost executor, stage retry) cannot
    reassign it.  Both paths treat a NULL group key as a group of its own; the offsets are
    broadcast only within the measured bounds of :func:`broadcast_if_small`.
    """
    spark = df.sparkSession
    most_in_one_task = _setting(spark, "singleTaskRows", SINGLE_TASK_ROWS)
    bound = most_in_one_task if single_task_rows is None else single_task_rows
    if bound > 0:
        if largest is None:
            largest = largest_group(df, by)
        if largest <= bound:
            w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) if by \
                else Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            return df.select("*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in sums])
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(parts, *[F.col(c) for c in by + order])
              .withColumn("_pid", F.spark_partition_id()))
    ranged = materialize(ranged, "running-totals")
    seg = by + ["_pid"]
    totals = ranged.groupBy(*seg).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*seg, *[
        F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums])
    upto = Window.partitionBy(*seg).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(upto).alias(f"_loc_{c}") for c in sums])
    keys = {c: f"_off_key_{i}" for i, c in enumerate(seg)}
    offsets, _ = broadcast_if_small(offsets.withColumnsRenamed(keys))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    joined = local.join(offsets, same)
    out_cols = [F.col(c) for c in df.columns]
    out_cols += [(F.col(f"_off_{c}") + F.col(f"_loc_{c}")).alias(f"cum_{c}") for c in sums]
    return holding(joined.select(*out_cols), offsets)


def unpivot_structs(df: DataFrame, rows: list[Column]) -> DataFrame:
    """Turn each row of ``df`` into ``len(rows)`` rows, one per struct expression."""
    return df.select(F.inline(F.array(*rows)))


def consecutive_ids(df: DataFrame, order: list[str], id_col: str = "event_id", start: int = 1) -> DataFrame:
    """Ids ``start, start+1, …`` in ``order`` (keys must be unique together), assigned as a
    running count — range partitions plus per-partition offsets above the single-task bound,
    never one unpartitioned ``row_number`` over the whole table."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), by=[], order=order, sums=["_one"])
    return counted.select(*[F.col(c) for c in df.columns],
                          (F.col("cum__one") + F.lit(start - 1)).alias(id_col))
