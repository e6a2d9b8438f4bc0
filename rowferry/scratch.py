"""Intermediate tables in a folder that driver and executors share.

Stages that must not be recomputed (random ids, positions in a sorted frame,
a table that the next work reads) are written as Parquet and read back. That
cuts lineage, survives lost executors and gives the next plan exact sizes, so
joins are planned on facts.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from rowferry.errors import ConfigError


def scratch_root(spark: SparkSession) -> str:
    """The folder set as ``spark.checkpoint.dir`` or by ``setCheckpointDir``.

    In local mode, where driver and tasks share one machine, the warehouse will do;
    a cluster has to name a folder that all its machines share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ConfigError("set spark.checkpoint.dir to a folder that all machines share")
    return (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def clean(spark: SparkSession, least_age_s: float = 0.0) -> int:
    """Delete scratch tables older than this, those of running jobs included; returns their number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/rowferry")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        if time.time() - status.getModificationTime() / 1000 >= least_age_s:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet; the caller owns what is written there."""
    return f"{scratch_root(spark)}/rowferry/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once, read many: the frame as a Parquet table in the scratch folder."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
