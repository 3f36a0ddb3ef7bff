"""Intermediate tables of the iterative operators, in the shared folder of ``spark.checkpoint.dir``.

:class:`Scratch` writes a frame as Parquet and rereads it, which cuts lineage and survives lost
executors.  A table that a later one replaces is deleted at once (:meth:`Scratch.drop`); what the
returned frame still reads stays until :func:`release` is called or Python exits.
"""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.session import ensure_checkpoint_dir

COLLECT_SECONDS = 10
_collected = 0.0
_HELD: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """A folder of its own for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-scratch/{name}-{uuid.uuid4().hex}"
        self._made = 0
        _HELD[self.root] = spark

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the written table."""
        self._made += 1
        path = f"{self.root}/{self._made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._collect()
        return out

    def _collect(self) -> None:
        """Let Spark's cleaner find the shuffle files of finished steps: it goes by what the driver's JVM
        has collected, which may be long ago.  At most once in COLLECT_SECONDS."""
        global _collected
        if time.monotonic() - _collected >= COLLECT_SECONDS:
            gc.collect()
            self.spark._jvm.System.gc()
            _collected = time.monotonic()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                _delete(self.spark, path)


#: Rows of a broadcast side; the sides passed to :func:`small` are ids, so some tens of MB.
BROADCAST_ROWS = 500_000


def small(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids as a join side: broadcast if it has at most ``most`` rows, else joined by
    a shuffle, whose skewed partitions Spark can split."""
    return F.broadcast(ids) if ids.count() <= most else ids.hint("merge")


#: Bytes of values of a broadcast side whose rows hold lists (see :func:`small_lists`).
BROADCAST_BYTES = 32 << 20


def small_lists(table: DataFrame, lists: str, entry_bytes: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The same for a written table with a column of lists: broadcast if rows (32 bytes each) and list entries
    hold at most ``most_bytes``."""
    size = table.agg(F.coalesce(F.sum(F.size(lists) * F.lit(entry_bytes).cast("long") + 32), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= most_bytes else table.hint("merge")


def release(spark: SparkSession | None = None) -> None:
    """Delete all scratch tables (of ``spark``); frames returned earlier can't be read afterwards."""
    for root, session in list(_HELD.items()):
        if spark is None or session is spark:
            _HELD.pop(root)
            try:
                _delete(session, root)
            except Exception as gone:  # the session has ended: its folder is the cluster's to clean
                if spark is not None:
                    raise gone


atexit.register(release)
