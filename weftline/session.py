"""Session set-up and the few cluster-facing helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "weftline", cores: str = "*", shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A local session with the settings the engine assumes; on a cluster pass your own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if memory:
        b = b.config("spark.driver.memory", memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def _shared(spark: SparkSession) -> str | None:
    """The folder that driver and executors share. Only a local session may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a folder of one machine would be lost with it")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests,
    notebooks) a local temporary folder is used. Never a local checkpoint: its blocks die with an executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(_shared(spark) or tempfile.mkdtemp(prefix="weftline-ckpt-"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share: under ``spark.checkpoint.dir``, or a local one where that is unset."""
    shared = _shared(spark)
    return f"{shared.rstrip('/')}/weftline-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="weftline-")


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is configured for; grows with the cluster, not with the code."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Catalyst prunes its columns at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on inputs of few splits: a plain scan with fewer partitions than cores is dealt out evenly.

    Inputs of a cluster's size have more splits than cores and stay as they are; so does anything that already
    holds an exchange. Rows and results are the same either way; only whole small files move.
    """
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df
