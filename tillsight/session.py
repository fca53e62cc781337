"""Spark session helpers.

The library never creates sessions itself; tests and ``bench.py`` use
:func:`local_session`.  Anything that cuts lineage asks :func:`checkpoint_dir`,
which honours ``spark.checkpoint.dir`` from the cluster configuration and only
falls back to a scratch folder when the setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tillsight") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TILLSIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) on a cluster")
        configured = tempfile.mkdtemp(prefix="tillsight-ckpt-")  # local mode only (tests)
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, name: str = "lineage-cut") -> DataFrame:
    """Cut lineage into the cluster's shared checkpoint folder.

    Used by iterative drivers (fold loops) so that a lost executor recomputes
    from the written table, not from the scan.  Implemented as a written
    Parquet table (:func:`materialize`): ``Dataset.checkpoint`` on an
    unpersisted plan would evaluate the plan twice.
    """
    return materialize(df, name)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillsight-tables/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a Parquet table below the shared checkpoint folder and reading it back.

    Unlike ``Dataset.checkpoint`` on an unpersisted plan (which evaluates the
    plan once to count and again to write), this runs the plan exactly once;
    readers get column pruning and predicate pushdown on the written table.
    """
    spark = df.sparkSession
    path = scratch_table(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
