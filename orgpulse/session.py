"""Session construction and the shared scratch / checkpoint folder.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names; it is read from
the session and never overridden.  Only when it is unset (local runs, tests) a private
folder is created and registered, so that ``DataFrame.checkpoint`` and scratch writes work.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


# What a session gets where the submitter (spark-submit, the environment) has set nothing.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


_LOCAL_DRIVER_MEMORY = "8g"


def _in_defaults_file(key: str) -> bool:
    """Whether the submitter's spark-defaults.conf names ``key``."""
    folder = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    try:
        with open(os.path.join(folder, "spark-defaults.conf")) as f:
            return any(re.match(rf"{re.escape(key)}[\s=]", line.strip()) for line in f)
    except OSError:
        return False


def _submitted() -> SparkConf:
    """Everything the submitter set (spark-submit, PYSPARK_SUBMIT_ARGS, spark-defaults.conf).  Only the JVM
    knows it, so the JVM is started first; the one default that must be there when it starts, the memory
    of a local driver, is passed in front of the submitter's own arguments, which win."""
    if SparkContext._active_spark_context:
        return SparkContext._active_spark_context.getConf()
    early = SparkConf(loadDefaults=False)
    given = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    named = re.search(r"(?:--master[ =]|spark\.master=)(\S+)", given)
    if (named is None or named[1].startswith("local")) and not _in_defaults_file("spark.driver.memory") \
            and "SPARK_DRIVER_MEMORY" not in os.environ:
        early.set("spark.driver.memory", _LOCAL_DRIVER_MEMORY)
    SparkContext._ensure_initialized(conf=early)
    conf = SparkConf()
    # what spark-submit fills in by itself wasn't submitted
    command = SparkContext._jvm.System.getProperty("sun.java.command") or ""
    own = {"spark.master": r"--master[ =]", "spark.app.name": r"--name[ =]", "spark.ui.showConsoleProgress": r"(?!)"}
    filled = {key for key, option in own.items() if not re.search(rf"{option}|{re.escape(key)}=", command) and not _in_defaults_file(key)}
    if "MASTER" in os.environ:
        filled.discard("spark.master")
    out = SparkConf(loadDefaults=False)
    for key, value in conf.getAll():
        if key not in filled:
            out.set(key, value)
    return out


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "orgpulse") -> SparkSession:
    """A session tuned for this library.  Settings passed in by the submitter win: a value is set only
    where the submitted configuration lacks it (a ``master`` or ``shuffle_partitions`` given here is
    such a default, too).  Without any master the session is local."""
    wanted = dict(_DEFAULTS)
    given = _submitted()
    if not given.contains("spark.master"):
        wanted["spark.master"] = master or "local[*]"
    if wanted.get("spark.master", given.get("spark.master", "")).startswith("local"):
        wanted["spark.sql.shuffle.partitions"] = "8"
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder
    if not given.contains("spark.app.name"):
        builder = builder.appName(app_name)
    for key, value in wanted.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering one only if the session has none.

    Order: the SparkContext's checkpoint dir, then the ``spark.checkpoint.dir`` setting, then
    — only for a ``local`` master (local runs, tests) — a fresh private folder.  On a cluster
    without the setting this raises instead of writing to a driver-local folder.  Works without a SparkContext too
    (Spark Connect), where only the setting is consulted."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir")
    master = str(spark.conf.get("spark.master", None) or (sc.master if sc is not None else ""))
    if not configured:
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(e.g. on HDFS or object storage); a driver-local folder is not usable here")
        configured = tempfile.mkdtemp(prefix="orgpulse-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:
            pass
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table written under :func:`scratch_path` that nothing reads any more."""
    if "/orgpulse-scratch/" not in path:
        raise ValueError(f"not a scratch table: {path}")
    delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for tables this library writes and reads back."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/orgpulse-scratch/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet under the shared folder and reading it back.

    One job (a checkpoint of an unpersisted plan computes it twice); the written files keep
    values that must not change on recomputation, such as a partition id, stable even when
    executors are lost.  Partitioning of the written rows is kept file-per-partition."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
