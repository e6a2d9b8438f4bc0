"""Batch-wise jobs over CSV: commits, crashes, resuming, refusals; row numbers of rejects."""

import pytest
from pyspark.sql import functions as F

from rowferry import (
    ABORT_ON_FIRST, JobError, Kind, MappingJob, Rule, VersionedTable, Work, abort_on_error_rate, col, run_mapping, run_works,
)
from rowferry.operators import numbering
from rowferry.sources.files import read_csv
from rowferry.sources.versions import create_once
from rowferry.streaming.ledger import ledger, run_ledger

RULES = [Rule(0, "k", "id", Kind.INTEGER, null_allowed=False), Rule(1, "v", "v", Kind.INTEGER)]


@pytest.fixture
def case(spark, folder):
    text = "k,v\n" + "".join(f"{i},{'bad' if i in (57, 58, 93) else 70_000 if i == 5 else i}\n" for i in range(100))
    path = f"{folder}/in.csv"
    with open(path, "w") as f:
        f.write(text)

    def job(**options):
        return MappingJob(read_csv(spark, path, row_no="line"), RULES, [], row="line", first_row=2, batch_size=20, **options)

    return job, VersionedTable.create(spark, f"{folder}/t", "id bigint, v int"), f"{folder}/job", path


def ids(spark, target):
    return sorted(r.id for r in target.read(spark).collect())


def test_equals_a_mapping_job_on_the_same_file(spark, case):
    job, target, folder, path = case
    result = run_ledger(spark, job(), target, "j", folder, path, guard="content")
    plain = run_mapping(job())
    assert (result.status, result.total_rows, result.success_rows, result.error_rows) == ("completed", 100, 97, 3)
    assert sorted(map(tuple, target.read(spark).collect())) == sorted(map(tuple, plain.tables["good"].collect()))
    assert sorted(map(tuple, result.rejects.collect())) == sorted(map(tuple, plain.rejects.collect()))
    log = [tuple(r) for r in ledger(spark, target, "j").orderBy("batch").collect()]
    assert log == [(b, 20, 20 - n, n, "completed" if b == 4 else "running", b + 1) for b, n in enumerate((0, 0, 2, 0, 1))]
    with pytest.raises(JobError, match="completed"):
        run_ledger(spark, job(), target, "j", folder, path, guard="content")


@pytest.mark.parametrize("where", ["data", "manifest"])
def test_a_crash_loses_and_doubles_nothing(spark, case, monkeypatch, where):
    job, target, folder, path = case
    calls = []

    def dies(real):
        def step(*args, **kwargs):
            calls.append(1)
            if len(calls) == 3:
                raise OSError("lost")
            return real(*args, **kwargs)
        return step

    name = "write_part" if where == "data" else "commit"
    monkeypatch.setattr(VersionedTable, name, dies(getattr(VersionedTable, name)))
    result = run_ledger(spark, job(), target, "j", folder, path)
    assert result.status == "failed" and "lost" in result.failure and result.success_rows == 40
    monkeypatch.undo()
    assert ids(spark, target) == list(range(40))
    result = run_ledger(spark, job(), target, "j", folder, path)
    assert (result.status, result.success_rows, result.error_rows) == ("completed", 97, 3)
    assert ids(spark, target) == [i for i in range(100) if i not in (57, 58, 93)]


def test_a_stopped_job_goes_on_after_its_last_batch(spark, case):
    job, target, folder, path = case
    result = run_ledger(spark, job(policy=ABORT_ON_FIRST), target, "j", folder, path)
    assert (result.status, result.success_rows, result.error_rows) == ("aborted", 40, 2) and result.failure
    assert [r.row for r in result.rejects.orderBy("row").collect()] == [59, 60]
    assert ids(spark, target) == list(range(40))
    again = run_ledger(spark, job(policy=ABORT_ON_FIRST), target, "j", folder, path)
    assert again.status == "aborted" and ids(spark, target) == list(range(40))
    result = run_ledger(spark, job(policy=abort_on_error_rate(50.0)), target, "j", folder, path)
    assert result.status == "completed" and len(ids(spark, target)) == 97


def test_running_changed_and_foreign_targets_are_refused(spark, case):
    job, target, folder, path = case
    assert create_once(spark, f"{folder}/running.json", "{}")
    with pytest.raises(JobError, match="running"):
        run_ledger(spark, job(), target, "j", folder, path)
    result = run_ledger(spark, job(policy=ABORT_ON_FIRST), target, "j", folder, path, take_over=True)
    assert result.status == "aborted"
    with open(path, "a") as f:
        f.write("100,1\n")
    with pytest.raises(JobError, match="changed"):
        run_ledger(spark, job(), target, "j", folder, path)


def test_values_beyond_the_stored_type_are_rejected(spark, case, folder):
    job, _, _, path = case
    target = VersionedTable.create(spark, f"{folder}/narrow", "id bigint, v smallint")
    result = run_ledger(spark, job(), target, "n", f"{folder}/narrow-job", path)
    assert result.status == "completed" and 5 not in ids(spark, target) and result.error_rows == 4


def test_an_empty_source_is_completed(spark, case):
    job, target, folder, _ = case
    empty = job()
    empty.source = empty.source.where("false")
    result = run_ledger(spark, empty, target, "e", folder)
    assert (result.status, result.total_rows) == ("completed", 0) and ids(spark, target) == []


def test_rejects_alone_are_numbered(spark, monkeypatch):
    """Nothing runs while a work is planned, and only order columns are written for numbers."""
    written, real = [], numbering.materialize
    monkeypatch.setattr(numbering, "materialize", lambda df, label, *a: written.append(df.columns) or real(df, label, *a))
    source = spark.range(500).select(
        (F.col("id") * 7 % 500).alias("k"), F.col("id").alias("wide"),
        F.when(F.col("id") % 50 == 3, "bad").otherwise("1").alias("n"), F.when(F.col("id") % 9 != 0, F.col("id") % 3).alias("grp"))
    target = spark.createDataFrame([], "wide bigint, n bigint")
    work = Work("w").source(source.repartition(6), "s", order_by=["grp", "k"], first_row=2).into("t").add(
        {"wide": col("s.wide"), "n": col("s.n")})
    plan = work.plan({"t": target})
    assert written == []
    result = run_works(spark, [work], {"t": target})
    rows = sorted(source.collect(), key=lambda r: (r.grp is not None, r.grp or 0, r.k))
    want = [i + 2 for i, r in enumerate(rows) if r.n == "bad"]
    assert sorted(r.row for r in result.rejects.collect()) == want
    assert written == [["grp", "k", "__pos"]] and plan is not None
    written.clear()
    fine = Work("f").source(source, "s", order_by="k").into("t").add({"wide": col("s.wide")})
    assert run_works(spark, [fine], {"t": target}).rejects.count() == 0 and written == []
