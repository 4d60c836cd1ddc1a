"""Session settings and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(name: str = "maieutic", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, ANSI, AQE with skew handling.

    Sizes that depend on the cluster (shuffle partitions, split size, memory) are
    left to the caller; AQE coalesces and splits shuffle partitions at run time.
    """
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k: str(v) for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode, where it is unset.

    Raises RuntimeError on a cluster without that setting: a machine-local folder
    would be lost with its machine.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="maieutic-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table beside the checkpoints and read back, with column pruning and known size.

    The table is deleted when the driver's JVM ends, or by discard.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table of stored, which nothing may read any more: all that was made of it must be stored or gathered itself."""
    jvm, path = table.sparkSession.sparkContext._jvm, getattr(table, "_stored_at", None)
    if path:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Deletes the shuffle files of df's run, which else stay until the driver happens to collect its garbage; a later run would make them anew."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        for shuffle in plan.context().shuffleIds().keySet().toArray():
            df.sparkSession.sparkContext._jsc.sc().shuffleDriverComponents().removeShuffle(shuffle, True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it holds at most so many rows, else as it is. Counts df: hand over a stored one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
