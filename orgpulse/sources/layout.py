"""Tables laid out by organization (S2, S4): bucketed, so that joins and groupings by organization need no shuffle.

A table is bucketed and sorted by (organization, ``org_salt``).  The salt spreads an organization that holds more rows
than an average bucket: its events get ``hash(event id) mod salts``, all others salt 0, so no bucket holds much
more than two average ones whatever the skew.  Fewer organizations than buckets can be that large, so their table
is broadcast.  Tables with a row per organization repeat that row for each salt of a large one, so that
(organization, salt) joins them with the events bucket by bucket; :func:`plain` gives the rows without the repeats.

Spark reads buckets only of catalog tables.  The files lie in the folder the caller names; the catalog entry is
made when the table is opened and dropped again (external: the files stay), so nothing is kept in the catalog and any
session that sees the folder can open it from what :class:`Layout` says.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.functions.goals import EVENT_ID, ORG

SALT = "org_salt"
KEYS = (ORG, SALT)


@dataclass(frozen=True)
class Layout:
    """How a set of tables is laid out: the same buckets and large organizations for all of them."""

    buckets: int
    large: DataFrame  # organization, salts; fewer rows than buckets


def layout_of(events: DataFrame, buckets: int | None = None) -> Layout:
    """Buckets (by default the shuffle partitions) and the organizations with more rows than an average bucket."""
    spark = events.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = events.groupBy(ORG).agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        mean = max(1.0, (sizes.agg(F.sum("_n")).first()[0] or 0) / buckets)
        found = sizes.where(F.col("_n") > mean).select(F.col(ORG).alias("_large"), F.ceil(F.col("_n") / mean).cast("int").alias("_salts")).collect()
    finally:
        sizes.unpersist()
    schema = T.StructType([T.StructField("_large", events.schema[ORG].dataType), T.StructField("_salts", T.IntegerType())])
    return Layout(buckets, spark.createDataFrame(found, schema))


def _with_salts(df: DataFrame, layout: Layout) -> DataFrame:
    return df.join(F.broadcast(layout.large), F.col(ORG).eqNullSafe(F.col("_large")) & F.col("_salts").isNotNull(), "left")


def salted_events(events: DataFrame, layout: Layout) -> DataFrame:
    """``events`` with their salt."""
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(EVENT_ID), F.col("_salts"))).otherwise(0)
    return _with_salts(events, layout).withColumn(SALT, salt.cast("int")).drop("_large", "_salts")


def salted_orgs(orgs: DataFrame, layout: Layout) -> DataFrame:
    """``orgs`` (a row per organization), repeated for each salt of its organization."""
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    return _with_salts(orgs, layout).withColumn(SALT, F.explode(salts)).drop("_large", "_salts")


def plain(orgs: DataFrame) -> DataFrame:
    """A table of :func:`salted_orgs` without repeats and salt."""
    return orgs.where(F.col(SALT) == 0).drop(SALT)


def write_laid_out(df: DataFrame, path: str, layout: Layout) -> DataFrame:
    """Write a salted table: one file per bucket, sorted.  Returns the written copy, bucketed."""
    spark, name = df.sparkSession, f"orgpulse_{uuid.uuid4().hex}"
    try:
        (df.repartition(layout.buckets, *KEYS).write.format("parquet").option("path", path)
         .bucketBy(layout.buckets, *KEYS).sortBy(*KEYS).saveAsTable(name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return open_laid_out(spark, path, df.schema, layout.buckets)


def open_laid_out(spark: SparkSession, path: str, schema: T.StructType, buckets: int) -> DataFrame:
    """A table that :func:`write_laid_out` wrote."""
    name, keys = f"orgpulse_{uuid.uuid4().hex}", ", ".join(KEYS)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    try:
        spark.sql(f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys})"
                  f" INTO {buckets} BUCKETS LOCATION '{where}'")
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
