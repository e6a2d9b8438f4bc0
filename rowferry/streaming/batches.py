"""Checkpointed batch runs on Structured Streaming.

Each micro-batch converts its files, checks the error policy and writes good
rows and rejects under its batch number. A batch that runs again after a crash
overwrites what it left behind, so nothing is written twice. Starting the same
job on the same checkpoint continues after the last committed batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry import messages as M
from rowferry.errors import ConfigError, JobError
from rowferry.operators.mapping import Rule, apply_rules
from rowferry.plans.mapping_job import ErrorPolicy, outcome_counts
from rowferry.sources.files import block_digests, changed_blocks, file_fingerprint, file_listing


@dataclass
class BatchJob:
    """Files of one folder, mapped by rules into ``<target>/rows`` and ``<target>/rejects``.

    ``row`` names the column with the row number. Batch size is set by files
    (``files_per_batch``) or bytes, since a cluster reads whole files. ``guard``
    tells how a resumed job checks that its files are unchanged: by ``listing``
    (sizes and change times only), by ``blocks`` (hashes of runs of lines, for files
    of any size; names what changed) or by ``content`` (one hash a file).
    """

    source: str
    schema: T.StructType
    rules: list[Rule]
    row: str
    target: str
    checkpoint: str
    format: str = "parquet"
    options: dict[str, str] | None = None
    files_per_batch: int = 1000
    policy: ErrorPolicy = ErrorPolicy()
    guard: str = "listing"


def run_batches(spark: SparkSession, job: BatchJob) -> DataFrame:
    """Run or resume until all files are done; returns ``batch_progress``.

    A job whose policy stops it raises ``JobError``; the batches before stay.
    """
    _guard(spark, job)
    stream = (
        spark.readStream.format(job.format)
        .schema(job.schema)
        .options(**(job.options or {}))
        .option("maxFilesPerTrigger", job.files_per_batch)
        .load(job.source)
    )
    stopped: list[str] = []

    def commit(batch: DataFrame, batch_id: int) -> None:
        stage = f"{job.target}/staged/batch={batch_id}"
        apply_rules(batch, job.rules, job.row).write.mode("overwrite").parquet(stage)
        tagged = batch.sparkSession.read.parquet(stage)
        now = outcome_counts(tagged).first()
        reason = _policy_reason(batch.sparkSession, job, batch_id, now)
        if reason:
            stopped.append(reason)
            raise JobError(reason)
        columns = [r.target_column for r in job.rules]
        good = tagged.where(F.col("__fail").isNull()).select("__row", *columns)
        bad = tagged.where(F.col("__fail").isNotNull()).select(
            F.col("__row").alias("row"), "__fail.column", "__fail.reason"
        )
        good.write.mode("overwrite").parquet(f"{job.target}/rows/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{job.target}/rejects/batch={batch_id}")
        counts = outcome_counts(tagged)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{job.target}/progress/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(commit)
        .option("checkpointLocation", job.checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        raise JobError(stopped[-1] if stopped else str(e)) from e
    return batch_progress(spark, job)


def _policy_reason(spark, job: BatchJob, batch_id: int, now) -> str | None:
    policy = job.policy
    if policy.kind == "first" and now["error_rows"]:
        return M.ABORT_ON_FIRST
    if policy.kind != "rate":
        return None
    before = batch_progress(spark, job)
    ok = bad = 0
    if before is not None:
        sums = before.where(F.col("batch") < batch_id).agg(
            F.sum("success_rows"), F.sum("error_rows")
        ).first()
        ok, bad = sums[0] or 0, sums[1] or 0
    errors = bad + now["error_rows"]
    seen = ok + errors + (now["success_rows"] if policy.counting == "inclusive" else 0)
    rate = errors / max(seen, 1) * 100.0
    if rate > policy.max_percent:
        return M.ABORT_ON_RATE.format(rate=rate, limit=f"{policy.max_percent:g}")
    return None


def batch_progress(spark: SparkSession, job: BatchJob) -> DataFrame | None:
    """``(batch, total_rows, success_rows, error_rows)`` of the committed batches."""
    try:
        done = spark.read.parquet(f"{job.target}/progress")
    except AnalysisException:
        return None
    return done.select(
        F.col("batch").cast("bigint").alias("batch"), "total_rows", "success_rows", "error_rows"
    )


def written_rows(spark: SparkSession, job: BatchJob) -> DataFrame:
    return spark.read.parquet(f"{job.target}/rows")


def rejected_rows(spark: SparkSession, job: BatchJob) -> DataFrame:
    return spark.read.parquet(f"{job.target}/rejects")


def _guard(spark: SparkSession, job: BatchJob) -> None:
    """Resume only over unchanged files: those seen at the start must hash the same."""
    if not job.rules:
        raise ConfigError("a mapping needs at least one rule")
    # The stream must not read its own results.
    if job.target.rstrip("/").startswith(job.source.rstrip("/") + "/"):
        raise ConfigError("target lies inside the source folder")
    stored_at = f"{job.target}/fingerprint"
    if job.guard not in GUARDS:
        raise ConfigError(f"guard must be one of {', '.join(GUARDS)}, not {job.guard}")
    files = GUARDS[job.guard](spark, job.source)
    try:
        stored = spark.read.parquet(stored_at)
    except AnalysisException:
        files.write.parquet(stored_at)
        return
    # Files that came since are new input; those seen at the start must be as they were.
    if job.guard == "blocks":
        seen = files.join(stored.select("path").distinct(), "path")
        changed = changed_blocks(stored, seen).select("path", F.concat(F.lit(" block "), "part").alias("at"))
    else:
        changed = stored.join(files.withColumnRenamed("sha256", "now"), "path", "left").where(
            F.col("now").isNull() | (F.col("now") != F.col("sha256"))
        ).select("path", F.lit("").alias("at"))
    first = changed.orderBy("path", "at").first()
    if first:
        raise JobError(f"source files changed since the job started ({first['path']}{first['at']}); run it anew")


GUARDS = {"listing": file_listing, "blocks": block_digests, "content": file_fingerprint}


__all__ = [
    "BatchJob", "batch_progress", "rejected_rows", "run_batches", "written_rows",
]
