"""Mapping jobs that commit batch by batch into a versioned table and can be resumed.

Converted rows are staged once, with their batch. Runs of batches are written into
one data folder each; every run is twice as long as the one before, so a job of any
number of batches is a handful of writes, and a crash costs no more than was
committed before. Each batch is then one manifest of the target, which lets readers
see the folder up to that batch and carries the job's log: batch, counts and state.
Rows and log are committed by the same atomic step, so a batch that died half way
is simply done again, and no row is seen twice. Which batch the error policy stops
at is decided from one small row for each batch.
"""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry import messages as M
from rowferry.errors import ConfigError, ConflictError, JobError
from rowferry.operators.mapping import good_rows, reject_rows
from rowferry.operators.numbering import batch_no
from rowferry.plans.mapping_job import MappingJob, aborting_batch, batch_stats
from rowferry.plans.result import JobResult
from rowferry.sources.files import combined_fingerprint, file_fingerprint, file_listing
from rowferry.sources.versions import STEP, Manifest, VersionedTable, create_once, exists, read_file, remove

_LOG = (
    "jobs map<string, struct<batch: bigint, batches: bigint, state: string, rows: array<bigint>, "
    "success_rows: bigint, error_rows: bigint>>"
)


def run_ledger(
    spark: SparkSession,
    job: MappingJob,
    target: VersionedTable,
    name: str,
    folder: str,
    source_path: str | None = None,
    guard: str = "listing",
    take_over: bool = False,
) -> JobResult:
    """Run or resume the job ``name``; ``folder`` is its own and keeps staged rows and the source's fingerprint.

    ``job.batch_size`` rows make a batch: on a cluster, millions. A finished job is
    refused, and so is one that is running, unless ``take_over`` says that its
    process is gone. A job that its policy stopped, or that failed, goes on after
    its last committed batch. With ``source_path`` it goes on only if the files are
    unchanged, by ``listing`` (sizes and change times) or ``content`` (hashes).
    """
    job.validate()
    if job.write_mode != "batches":
        raise ConfigError("only jobs that write in batches can be resumed")
    if guard not in ("listing", "content"):
        raise ConfigError(f"guard must be content or listing, not {guard}")
    folder, began = folder.rstrip("/"), time.monotonic()
    base = target.manifest(spark)
    last = base.jobs.get(name)
    if last and last["state"] == "completed":
        raise JobError(f"job [{name}] is completed and cannot be resumed")
    lock = f"{folder}/running.json"
    if take_over:
        remove(spark, lock)
    if not create_once(spark, lock, json.dumps({"host": socket.gethostname(), "at": time.time()})):
        raise JobError(f"job [{name}] is running and cannot be resumed")
    try:
        _unchanged(spark, folder, source_path, guard, name)
        staged = _staged(spark, job, target, base, folder)
        result = _commit_batches(spark, job, target, base, name, staged)
    finally:
        remove(spark, lock)
    result.elapsed_seconds = time.monotonic() - began
    return result


def _unchanged(spark: SparkSession, folder: str, source_path: str | None, guard: str, name: str) -> None:
    if source_path is None:
        return
    files = (file_fingerprint if guard == "content" else file_listing)(spark, source_path)
    now = json.dumps({"guard": guard, "digest": combined_fingerprint(files)})
    if not create_once(spark, f"{folder}/source.json", now) and read_file(spark, f"{folder}/source.json") != now:
        raise JobError(f"source files of job [{name}] changed since it started; run it anew")


def _staged(spark: SparkSession, job: MappingJob, target: VersionedTable, base: Manifest, folder: str) -> DataFrame:
    """Converted rows with ``batch``, written once however often the job is resumed."""
    path = f"{folder}/staged"
    tagged = job.tagged({f.name: f for f in base.schema})
    rows = tagged.withColumn("batch", batch_no(F.col("__row"), job.first_row, job.batch_size))
    if not exists(spark, f"{path}/_SUCCESS"):
        # Sorted within tasks, so that the rows of a run of batches are found by the files' statistics.
        rows.sortWithinPartitions("batch").write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _commit_batches(
    spark: SparkSession, job: MappingJob, target: VersionedTable, base: Manifest, name: str, staged: DataFrame
) -> JobResult:
    last = base.jobs.get(name)
    done = last["batch"] + 1 if last else 0
    stats = batch_stats(staged, job.first_row, job.batch_size)
    counts = {r["batch"]: (r["ok_rows"], r["error_rows"]) for r in stats.collect()}  # one row for each batch
    stop = aborting_batch(stats, job.policy).first()
    stop_at = None if stop["batch"] is None else max(stop["batch"], done)
    batches, result = max(counts, default=-1) + 1, JobResult()
    reason = None
    if stop_at is not None:
        reason = M.ABORT_ON_FIRST if job.policy.kind == "first" else (
            M.ABORT_ON_RATE.format(rate=stop["rate"], limit=f"{job.policy.max_percent:g}")
        )

    ok_rows, error_rows = (
        list(accumulate((counts.get(b, (0, 0))[i] for b in range(batches)), initial=0)) for i in (0, 1)
    )

    def log(batch: int, state: str) -> dict:
        seen = min(batch + 1, batches)
        return {
            **base.jobs,
            name: {
                "batch": batch, "batches": batches, "state": state, "rows": list(counts.get(batch, (0, 0))),
                "success_rows": ok_rows[seen], "error_rows": error_rows[seen],
            },
        }

    try:
        for run in _runs(done, batches if stop_at is None else stop_at):
            stepped = staged.where(F.col("batch").between(run[0], run[-1])).withColumn(STEP, F.col("batch"))
            part = target.write_part(good_rows(stepped, [*job.target_columns, STEP]), base.schema)
            parts, steps = [*base.parts, part], base.steps
            for batch in run:
                state = "completed" if batch == batches - 1 else "running"
                seen = steps if batch == run[-1] else {**steps, part: batch}
                base = target.commit(spark, base, parts, f"batch {batch}", log(batch, state), seen)
        if not batches:
            base = target.commit(spark, base, list(base.parts), "no batch", log(-1, "completed"))
        if stop_at is not None:
            base = target.commit(spark, base, list(base.parts), "aborted", log(stop_at - 1, "aborted"))
            result.status, result.failure = "aborted", reason
    except ConfigError:
        raise
    except Exception as e:  # noqa: BLE001 - committed batches stay, the job can be resumed
        result.status, result.failure = "failed", str(e)
        if isinstance(e, ConflictError):
            result.failure = f"another job wrote the target: {e}"
    entry = base.jobs.get(name) or {"success_rows": 0, "error_rows": 0, "batch": -1}
    result.total_rows = sum(ok + bad for ok, bad in counts.values())
    result.success_rows, result.error_rows = entry["success_rows"], entry["error_rows"]
    shown = entry["batch"] if stop_at is None or result.status == "failed" else stop_at
    result.rejects = reject_rows(staged.where(F.col("batch") <= shown))
    if result.status == "aborted":
        result.error_rows += counts.get(stop_at, (0, 0))[1]
    result.versions = {name: base.version}
    return result


def _runs(start: int, end: int) -> Iterator[range]:
    """Batches ``start`` to ``end`` (exclusive) in runs, each as long as all before it."""
    at = start
    while at < end:
        run = range(at, min(at + max(at - start, 1), end))
        yield run
        at = run.stop


def ledger(spark: SparkSession, target: VersionedTable, name: str) -> DataFrame:
    """The job's log: ``(batch, total_rows, success_rows, error_rows, state, version)`` of every batch that can still be read."""
    entry = F.try_element_at(F.from_json("text", _LOG)["jobs"], F.lit(name))
    entries = target.manifests(spark).select("version", entry.alias("entry")).where(F.col("entry").isNotNull())
    # A version of another change carries the entry of the version before.
    before = entries.select((F.col("version") + 1).alias("version"), F.col("entry").alias("seen"))
    made = entries.join(before, "version", "left").where(~F.col("entry").eqNullSafe(F.col("seen")))
    ok, bad = F.col("entry.rows")[0], F.col("entry.rows")[1]
    return made.select(
        "entry.batch", (ok + bad).alias("total_rows"), ok.alias("success_rows"), bad.alias("error_rows"),
        "entry.state", "version",
    )
