"""What a job reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from rowferry.functions.generators import JobClock

# Fixed value: reject details shown in a report; the total is counted apart.
REPORT_ROWS = 1000

SUMMARY_SCHEMA = (
    "status string, total_rows bigint, success_rows bigint, error_rows bigint, failure string"
)


@dataclass
class WorkCounts:
    name: str
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    rejected: int = 0


@dataclass
class JobResult:
    clock: JobClock = field(default_factory=JobClock)
    status: str = "completed"
    total_rows: int = 0
    success_rows: int = 0
    error_rows: int = 0
    failure: str | None = None
    works: list[WorkCounts] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    inserted: dict[str, list[DataFrame]] = field(default_factory=dict)
    rejects: DataFrame | None = None
    #: Seconds from the first count to the last write.
    elapsed_seconds: float = 0.0
    #: Versions of the written tables after the job.
    versions: dict[str, int] = field(default_factory=dict)
    #: Lazy: keys and hidden rows of each lookup.
    duplicates: list[DataFrame] = field(default_factory=list)

    def lookup_duplicates(self) -> DataFrame | None:
        """``(work, lookup, keys, duplicates)``: rows of lookups that a later row of the same key hides."""
        return reduce(lambda a, b: a.unionAll(b), self.duplicates) if self.duplicates else None

    def report(self, rows: int = REPORT_ROWS) -> DataFrame | None:
        """The first rejects by row number; ``rejects`` holds all of them."""
        return None if self.rejects is None else reject_report(self.rejects, rows)

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.status, self.total_rows, self.success_rows, self.error_rows, self.failure)],
            SUMMARY_SCHEMA,
        )


def reject_report(rejects: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    return rejects.orderBy("row").limit(rows)
