"""Shared folder for intermediate tables.

Intermediate results that several branches read are written once, as Parquet, to the folder the
cluster names in ``spark.checkpoint.dir``; a lost executor then costs a re-read, not a re-run of the
lineage, and the optimiser sees real file sizes when it chooses join strategies.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for an unset local session."""
    context = spark.sparkContext
    configured = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError(f"set {SETTING} to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tradelattice-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tradelattice/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
