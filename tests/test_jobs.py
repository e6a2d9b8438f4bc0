"""Mapping jobs, policies, numbering, batches, checkpointed runs."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry import ABORT_ON_FIRST, ConfigError, JobError, Kind, MappingJob, Rule, abort_on_error_rate, run_mapping
from rowferry.operators.mapping import auto_match, auto_rules
from rowferry.operators.numbering import running_totals, with_row_no
from rowferry.plans.mapping_job import aborting_batch
from rowferry.streaming.batches import BatchJob, batch_progress, rejected_rows, run_batches, written_rows

CRATES = [(1, "81", "cork", "7.25", "false", "2031-03-09"), (2, "82", "rope", None, "true", "2031/04/10"),
          (3, "eighty", "tar", "3", "false", "2031-05-11"), (4, "84", None, "3", "maybe", "?")]
RULES = [Rule(1, "no", "crate", Kind.INTEGER, False), Rule(2, "goods", "goods", Kind.TEXT, False),
         Rule(3, "weight", "weight", Kind.FLOAT), Rule(4, "sealed", "sealed", Kind.BOOL), Rule(5, "due", "due", Kind.DATE)]


def crates(spark, **options):
    df = spark.createDataFrame(CRATES, "o int, no string, goods string, weight string, sealed string, due string")
    return MappingJob(df, RULES, order_by=["o"], first_row=2, **options)


def test_mapping_job(spark, folder):
    result = run_mapping(crates(spark), f"{folder}/out")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/out").orderBy("crate").collect()]
    assert [r[:4] for r in rows] == [(81, "cork", 7.25, False), (82, "rope", None, True)]
    assert str(rows[1][4]) == "2031-04-10"
    assert (result.status, result.total_rows, result.success_rows, result.error_rows) == ("completed", 4, 2, 2)
    assert [tuple(r) for r in result.report().collect()] == [
        (4, "no", "無法將「eighty」解析為整數"), (5, "goods", "欄位為空，但 NULL 政策為不允許")]
    assert result.summary(spark).first()["success_rows"] == 2


def test_all_or_nothing(spark, folder):
    aborted = run_mapping(crates(spark, policy=ABORT_ON_FIRST, write_mode="all_or_nothing"), f"{folder}/a")
    assert (aborted.status, aborted.success_rows, aborted.error_rows) == ("aborted", 0, 2)
    assert "全有全無" in aborted.failure
    even = run_mapping(crates(spark, policy=abort_on_error_rate(50), write_mode="all_or_nothing"), f"{folder}/b")
    assert (even.status, even.success_rows) == ("completed", 2)  # only above the limit aborts
    over = run_mapping(crates(spark, policy=abort_on_error_rate(49.9), write_mode="all_or_nothing"), f"{folder}/c")
    assert over.status == "aborted"


def test_batches_before_the_failing_one_stay(spark, folder):
    result = run_mapping(crates(spark, policy=ABORT_ON_FIRST, batch_size=2), f"{folder}/out")
    assert (result.status, result.success_rows, result.error_rows) == ("aborted", 2, 2)
    rate = run_mapping(crates(spark, policy=abort_on_error_rate(30), batch_size=1), f"{folder}/rate")
    assert (rate.status, rate.success_rows, rate.error_rows) == ("aborted", 2, 1)
    assert rate.failure == "錯誤率 33.3% 超過上限 30%"


def test_validation(spark):
    with pytest.raises(ConfigError):
        MappingJob(spark.range(1), [], ["id"]).tagged()
    with pytest.raises(ConfigError):
        MappingJob(spark.range(1), RULES, []).tagged()
    with pytest.raises(ConfigError):
        abort_on_error_rate(5, "sometimes")


def test_auto_match(spark):
    source = spark.createDataFrame([], "ID int, other int, Name string")
    target = spark.createDataFrame([], "name string, id bigint, missing date")
    assert auto_match(source, target.columns) == {"id": "ID", "name": "Name"}
    assert [(r.source_index, r.target_column, r.target_kind) for r in auto_rules(source, target)] == [
        (0, "id", Kind.INTEGER), (2, "name", Kind.TEXT)]


def test_row_numbers_on_any_order(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "concat('k', lpad(cast(id * 7919 % 5000 as string), 5, '0')) as k")
    got = with_row_no(df.withColumn("rnd", F.rand(3)), ["k"], first=10)
    want = df.selectExpr("id", "row_number() over (order by k) + 9 as n")
    assert got.join(want, "id").where("row_no <> n").count() == 0
    assert got.agg(F.min("row_no"), F.max("row_no"), F.count_distinct("row_no")).first() == (10, 5009, 5000)


def test_running_totals(spark):
    df = spark.range(1000).selectExpr("id as b", "id % 7 as e")
    got = running_totals(df, "b", ["e"], block=64).orderBy("b").collect()
    total = 0
    for r in got:
        assert r["e_before"] == total
        total += r["e"]


def test_error_rate_over_batches(spark):
    stats = spark.createDataFrame([(0, 90, 10), (1, 100, 0), (2, 10, 90), (3, 0, 100)], "batch bigint, ok_rows bigint, error_rows bigint")
    assert aborting_batch(stats, abort_on_error_rate(33)).first()["batch"] == 2
    assert aborting_batch(stats, abort_on_error_rate(60)).first()["batch"] is None
    late = aborting_batch(stats, abort_on_error_rate(50, "late")).first()
    assert (late["batch"], late["rate"]) == (0, 100.0)


SCHEMA = T.StructType([T.StructField("line", T.LongType()), T.StructField("n", T.StringType())])
BATCH_RULES = [Rule(0, "n", "n", Kind.INTEGER)]


def batch_job(spark, folder, bad=()):
    for i in range(4):
        rows = [(i * 10 + k, "bad" if (i, k) in bad else str(k)) for k in range(10)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return BatchJob(f"{folder}/in", SCHEMA, BATCH_RULES, "line", f"{folder}/out", f"{folder}/cp", files_per_batch=1)


def test_batches_commit_once_and_resume(spark, folder):
    job = batch_job(spark, folder, bad={(1, 3), (2, 4)})
    first = run_batches(spark, job)
    assert first.agg(F.count("*"), F.sum("success_rows"), F.sum("error_rows")).first() == (4, 38, 2)
    again = run_batches(spark, job)  # nothing left to do, nothing written twice
    assert again.count() == 4 and written_rows(spark, job).count() == 38
    assert [r["row"] for r in rejected_rows(spark, job).orderBy("row").collect()] == [13, 24]
    assert {r["reason"] for r in rejected_rows(spark, job).collect()} == {"無法將「bad」解析為整數"}


def test_stopped_job_resumes_after_its_last_batch(spark, folder):
    job = batch_job(spark, folder, bad={(2, 0)})
    job.policy = ABORT_ON_FIRST
    with pytest.raises(JobError, match="首錯即停"):
        run_batches(spark, job)
    done = batch_progress(spark, job)
    before = 0 if done is None else done.count()
    assert before < 4
    job.policy = abort_on_error_rate(50)
    assert run_batches(spark, job).count() == 4
    assert written_rows(spark, job).count() == 39


def test_changed_files_are_not_resumed(spark, folder):
    import pyarrow as pa
    import pyarrow.parquet as pq

    job = batch_job(spark, folder)
    pq.write_table(pa.table({"line": [90], "n": ["1"]}), f"{folder}/in/extra.parquet")
    assert run_batches(spark, job).count() == 5
    pq.write_table(pa.table({"line": [90], "n": ["2"]}), f"{folder}/in/extra.parquet")
    with pytest.raises(JobError, match="changed"):
        run_batches(spark, job)


def test_changed_blocks_are_named(spark, folder):
    job = batch_job(spark, folder)
    job.guard = "blocks"
    assert run_batches(spark, job).count() == 4
    assert run_batches(spark, job).count() == 4
    part = next(p for p in sorted(os.listdir(job.source)) if p.endswith(".parquet"))
    with open(f"{job.source}/{part}", "ab") as f:
        f.write(b"\n")
    os.remove(f"{job.source}/.{part}.crc")  # of the bytes before
    with pytest.raises(JobError, match=f"{part} block 0"):
        run_batches(spark, job)


def test_listing_guard_and_checks(spark, folder):
    job = batch_job(spark, folder)
    job.guard, job.files_per_batch = "listing", 4
    assert run_batches(spark, job).count() == 1
    assert run_batches(spark, job).count() == 1
    job.guard = "none"
    with pytest.raises(ConfigError):
        run_batches(spark, job)
    job.target = job.source + "/out"
    with pytest.raises(ConfigError):
        run_batches(spark, job)
