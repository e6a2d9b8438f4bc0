"""Writing: append to a table, publish a snapshot, export CSV, JDBC."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rowferry.errors import ConfigError
from rowferry.functions.text import display
from rowferry.sources.versions import fitted
from rowferry.types import Kind, quoted, values_of

# Date formats of exported text.
EXPORT_DATETIME = "yyyy-MM-dd HH:mm:ss"
EXPORT_DATE = "yyyy-MM-dd"


def append_rows(df: DataFrame, target: str, partition_by: list[str] | None = None) -> None:
    """Append to a catalog table or Parquet folder in one committed job.

    Columns are matched by name and take the stored types; a value that does not
    fit its type fails the job before anything is committed.
    """
    if "/" in target:
        stored = _stored_schema(df.sparkSession, target)
        if stored is not None:
            df = _as_stored(df, stored, target, partition_by or [])
        writer = df.write.mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    elif df.sparkSession.catalog.tableExists(target):
        columns = df.sparkSession.table(target).columns
        given = {c.lower(): c for c in df.columns}
        missing = [c for c in df.columns if c.lower() not in {t.lower() for t in columns}]
        if missing:
            raise ConfigError(f"target {target} has no column {', '.join(missing)}")
        padded = df.selectExpr(
            *[quoted(given[c.lower()]) if c.lower() in given else f"null as {quoted(c)}" for c in columns]
        )
        padded.write.mode("append").insertInto(target)
    else:
        writer = df.write.mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(target)


def _stored_schema(spark: SparkSession, folder: str) -> T.StructType | None:
    """The types of a Parquet folder; None if there is none yet."""
    try:
        return spark.read.parquet(folder).schema
    except AnalysisException:
        return None


def _as_stored(df: DataFrame, stored: T.StructType, target: str, partition_by: list[str]) -> DataFrame:
    """Partition columns stay as they are: their stored type is only a guess from folder names."""
    own = {f.name.lower(): f for f in df.schema}
    parts = {c.lower() for c in partition_by}
    unknown = [c for c in df.columns if c.lower() not in {f.name.lower() for f in stored}]
    if unknown:
        raise ConfigError(f"target {target} has no column {', '.join(unknown)}")
    kept = [own[f.name.lower()] if f.name.lower() in parts and f.name.lower() in own else f for f in stored]
    return fitted(df, T.StructType(kept), target)


def publish_snapshot(
    df: DataFrame, target: str, partition_by: list[str] | None = None, touched_only: bool = False
) -> None:
    """Replace a table by a staged snapshot.

    ``touched_only`` replaces only the partitions present in ``df``, so a merge
    that touches few partitions does not rewrite the whole table. A partition that
    lost all its rows is not present in ``df`` and would stay: replace the whole
    table after deletes, or drop such partitions. A frame that reads the target is
    refused: overwriting would delete its source. Write it to scratch first.
    """
    if _reads(df, target):
        raise ConfigError(f"the snapshot reads {target}, which it would replace; materialize it first")
    writer = df.write.mode("overwrite")
    if touched_only:
        if not partition_by:
            raise ConfigError("touched_only needs the partition columns")
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target) if "/" in target else writer.saveAsTable(target)


def _reads(df: DataFrame, target: str) -> bool:
    if "/" in target:
        folder = f"/{target.split(':', 1)[-1].strip('/')}/"
        return any(folder in re.sub("/+", "/", unquote(f)) for f in df.inputFiles())
    catalog = df.sparkSession.catalog
    stored = df.sparkSession.table(target).inputFiles() if catalog.tableExists(target) else []
    return bool(set(stored) & set(df.inputFiles()))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every file; numbers and dates in their display form."""
    shown = df.select(
        *[
            (display(v) if v.kind in (Kind.FLOAT, Kind.CELL) else v.column).alias(n)
            for n, v in values_of(df).items()
        ]
    )
    (
        shown.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("timestampNTZFormat", EXPORT_DATETIME)
        .option("dateFormat", EXPORT_DATE)
        .csv(path)
    )


def write_jdbc(
    df: DataFrame, connection: dict[str, str], table: str, batch_size: int = 5000,
    connections: int = 32,
) -> None:
    """Append over JDBC with a bounded number of connections."""
    df.write.format("jdbc").mode("append").options(
        **connection, dbtable=table, batchsize=str(batch_size), numPartitions=str(connections)
    ).save()
