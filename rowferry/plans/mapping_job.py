"""Mapping jobs: rules, error policies, all-or-nothing and batch-wise writing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from rowferry import messages as M
from rowferry.errors import ConfigError
from rowferry.operators.mapping import Rule, apply_rules, good_rows, reject_rows
from rowferry.operators.numbering import batch_no, running_totals, with_row_no
from rowferry.plans.result import JobResult
from rowferry.scratch import materialize
from rowferry.sources.sinks import append_rows

# Fixed value: rows per batch unless a job says otherwise.
BATCH_SIZE = 5000


@dataclass(frozen=True)
class ErrorPolicy:
    """``skip`` and report, ``first`` error aborts, or abort above ``max_percent``.

    ``counting`` tells what batch-wise error rates count as seen: ``inclusive``
    takes all rows up to the current batch, ``late`` leaves out the good rows of
    the current batch, as these are not written yet when the rate is checked.
    """

    kind: str = "skip"
    max_percent: float = 100.0
    counting: str = "inclusive"

    def __post_init__(self):
        if self.kind not in ("skip", "first", "rate"):
            raise ConfigError(f"unknown error policy {self.kind}")
        if self.counting not in ("inclusive", "late"):
            raise ConfigError(f"unknown way of counting {self.counting}")


SKIP_AND_REPORT = ErrorPolicy("skip")
ABORT_ON_FIRST = ErrorPolicy("first")


def abort_on_error_rate(max_percent: float, counting: str = "inclusive") -> ErrorPolicy:
    return ErrorPolicy("rate", max_percent, counting)


@dataclass
class MappingJob:
    source: DataFrame
    rules: list[Rule]
    order_by: list[str]
    row: str | None = None
    first_row: int = 1
    policy: ErrorPolicy = field(default_factory=ErrorPolicy)
    write_mode: str = "batches"
    batch_size: int = BATCH_SIZE

    def validate(self) -> None:
        if not self.rules:
            raise ConfigError("a mapping needs at least one rule")
        if self.write_mode not in ("batches", "all_or_nothing"):
            raise ConfigError(f"unknown write mode {self.write_mode}")
        if self.row is None and not self.order_by:
            raise ConfigError("a mapping needs order_by or a column with row numbers")

    @property
    def target_columns(self) -> list[str]:
        return [r.target_column for r in self.rules]

    def tagged(self, stored: dict[str, StructField] | None = None) -> DataFrame:
        """Target columns, ``__row`` and ``__fail`` for every source row; ``stored``: types that values must fit."""
        self.validate()
        if self.row is not None:
            return apply_rules(self.source, self.rules, self.row, stored=stored)
        numbered = with_row_no(self.source, self.order_by, self.first_row, "__row_no")
        return apply_rules(numbered, self.rules, "__row_no", stored=stored)


def outcome_counts(tagged: DataFrame) -> DataFrame:
    """``(total_rows, success_rows, error_rows)`` in one partial aggregate."""
    bad = F.count_if(F.col("__fail").isNotNull())
    return tagged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        (F.count(F.lit(1)) - bad).alias("success_rows"),
        bad.alias("error_rows"),
    )


def batch_stats(tagged: DataFrame, first_row: int, batch_size: int) -> DataFrame:
    """``(batch, ok_rows, error_rows)``."""
    bad = F.count_if(F.col("__fail").isNotNull())
    return tagged.groupBy(batch_no(F.col("__row"), first_row, batch_size).alias("batch")).agg(
        (F.count(F.lit(1)) - bad).alias("ok_rows"), bad.alias("error_rows")
    )


def aborting_batch(stats: DataFrame, policy: ErrorPolicy) -> DataFrame:
    """One row: the first batch at which the policy stops, with the rate there; NULL if none."""
    if policy.kind == "first":
        return stats.agg(
            F.min(F.when(F.col("error_rows") > 0, F.col("batch"))).alias("batch"),
            F.lit(None).cast("double").alias("rate"),
        )
    if policy.kind == "skip":
        return stats.agg(
            F.min(F.when(F.lit(False), F.col("batch"))).alias("batch"),
            F.lit(None).cast("double").alias("rate"),
        )
    totals = running_totals(stats, "batch", ["ok_rows", "error_rows"])
    errors = F.col("error_rows_before") + F.col("error_rows")
    seen = F.col("ok_rows_before") + errors
    if policy.counting == "inclusive":
        seen = seen + F.col("ok_rows")
    rate = errors / F.greatest(seen, F.lit(1)) * F.lit(100.0)
    over = totals.select("batch", rate.alias("rate")).where(
        F.col("rate") > F.lit(float(policy.max_percent))
    )
    return over.agg(
        F.min("batch").alias("batch"), F.min_by("rate", "batch").alias("rate")
    )


def policy_verdict(tagged: DataFrame, policy: ErrorPolicy) -> DataFrame:
    """All-or-nothing decision: ``(status, total_rows, success_rows, error_rows)``."""
    counts = outcome_counts(tagged)
    if policy.kind == "first":
        abort = F.col("error_rows") > 0
    elif policy.kind == "rate":
        abort = (F.col("total_rows") > 0) & (
            F.col("error_rows") * F.lit(100.0) > F.col("total_rows") * F.lit(float(policy.max_percent))
        )
    else:
        abort = F.lit(False)
    return counts.select(
        F.when(abort, "aborted").otherwise("completed").alias("status"),
        "total_rows",
        F.when(abort, F.lit(0)).otherwise(F.col("success_rows")).cast("bigint").alias("success_rows"),
        "error_rows",
    )


def run_mapping(job: MappingJob, target: str | None = None) -> JobResult:
    """Convert, apply the policy, write; ``target`` is a table or folder, None writes nothing.

    The conversion is staged once; counts, good rows and rejects are reads of it.
    Batch-wise jobs keep the batches before the one that stopped them. They are
    decided from one small row per batch and written in one job; for batches
    that commit one by one and can be resumed see ``rowferry.streaming``.
    """
    tagged = materialize(job.tagged(), "mapping")
    result = JobResult()
    good, bad = tagged, tagged
    if job.write_mode == "all_or_nothing":
        verdict = policy_verdict(tagged, job.policy).first()
        result.status = verdict["status"]
        result.total_rows, result.error_rows = verdict["total_rows"], verdict["error_rows"]
        result.success_rows = verdict["success_rows"]
        if result.status == "aborted":
            result.failure = M.ABORT_ALL_OR_NOTHING
            good = tagged.where(F.lit(False))
    else:
        stop = None
        if job.policy.kind != "skip":
            stats = batch_stats(tagged, job.first_row, job.batch_size)
            stop = aborting_batch(stats, job.policy).first()
        if stop is not None and stop["batch"] is not None:
            number = batch_no(F.col("__row"), job.first_row, job.batch_size)
            good, bad = tagged.where(number < stop["batch"]), tagged.where(number <= stop["batch"])
            result.status = "aborted"
            result.failure = M.ABORT_ON_FIRST if job.policy.kind == "first" else (
                M.ABORT_ON_RATE.format(rate=stop["rate"], limit=f"{job.policy.max_percent:g}")
            )
        result.total_rows = tagged.count()
        result.success_rows = good.where(F.col("__fail").isNull()).count()
        result.error_rows = bad.where(F.col("__fail").isNotNull()).count()
    rows = good_rows(good, job.target_columns)
    result.rejects = reject_rows(bad)
    if target is not None and result.success_rows:
        try:
            append_rows(rows, target)
        except ConfigError:
            raise
        except Exception as e:  # noqa: BLE001 - a failed write is a job outcome
            result.status, result.failure, result.success_rows = "failed", str(e), 0
    result.tables = {"good": rows}
    return result
