"""Session settings and the shared-folder helpers every job uses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session_builder(app_name: str = "lanecost") -> SparkSession.Builder:
    """Settings the jobs rely on; sizes are left to the cluster and to AQE."""
    return (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; where it names none, a folder of the warehouse,
    which every executor reaches as well."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for a written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written copy.

    Used where a small result of a large scan feeds several branches: every
    branch then reads the copy and a lost executor never repeats the scan.
    A written table keeps exact size statistics, so later joins are planned on
    the real size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_rows(scan: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan to all cores when its files give fewer splits than cores.

    For CPU-heavy row work on few files. A scan that already has enough splits, which is
    every large one, is returned as it is. Planning only, no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)
