"""Jobs of many batches: few writes, small manifests, every version exact; crashes within a run; the log read by tasks."""

import json

import pytest
from pyspark.sql import functions as F

from queries import jobs
from rowferry import Kind, MappingJob, Rule, VersionedTable
from rowferry.sources.versions import STEP, create_once
from rowferry.streaming.ledger import _runs, ledger, run_ledger

RULES = [Rule(0, "k", "id", Kind.INTEGER, null_allowed=False), Rule(1, "v", "v", Kind.INTEGER)]
BAD = (7, 8, 30)


@pytest.fixture
def case(spark, folder):
    """40 rows in batches of two, out of order and over several files."""
    rows = spark.range(40).repartition(3).select(
        (F.col("id") + 1).alias("line"), F.col("id").alias("k"),
        F.when(F.col("id").isin(*BAD), "bad").otherwise(F.col("id").cast("string")).alias("v"))
    job = MappingJob(rows, RULES, [], row="line", batch_size=2)
    return job, VersionedTable.create(spark, f"{folder}/t", "id bigint, v int"), f"{folder}/job"


def ids(frame):
    return sorted(r.id for r in frame.collect())


def good(n):
    return [i for i in range(n) if i not in BAD]


def test_many_batches_are_a_handful_of_writes(spark, case, monkeypatch):
    job, target, folder = case
    written, write = [], VersionedTable.write_part
    monkeypatch.setattr(VersionedTable, "write_part", lambda self, df, schema: written.append(1) or write(self, df, schema))
    result = run_ledger(spark, job, target, "j", folder)
    assert (result.status, result.success_rows, result.error_rows) == ("completed", 37, 3)
    assert len(written) == 6  # runs of 1, 1, 2, 4, 8 and 4 batches
    last = target.manifest(spark)
    assert last.version == 20 and len(last.parts) == 6 and not last.steps
    # Each batch is a version of its own, and what it shows ends with that batch.
    for batch in (0, 1, 2, 4, 6, 9, 15, 18, 19):
        found = target.read(spark, batch + 1)
        assert ids(found) == good(2 * batch + 2) and found.columns == ["id", "v"]
    log = [tuple(r) for r in ledger(spark, target, "j").orderBy("batch").collect()]
    bad = {3: 1, 4: 1, 15: 1}
    assert log == [
        (b, 2, 2 - bad.get(b, 0), bad.get(b, 0), "completed" if b == 19 else "running", b + 1) for b in range(20)
    ]


def test_manifests_do_not_grow_with_the_batches(spark, case):
    job, target, folder = case
    run_ledger(spark, job, target, "j", folder)
    sizes = [len(r.text) for r in target.manifests(spark).orderBy("version").collect()]
    assert len(sizes) == 21 and max(sizes[10:]) - min(sizes[10:]) < 150


def test_a_crash_within_a_run_hides_its_later_batches(spark, case, monkeypatch):
    job, target, folder = case
    commits, commit = [], VersionedTable.commit

    def dies(*args, **kwargs):
        commits.append(1)
        if len(commits) == 7:  # batch 6, in the run of batches 4 to 7
            raise OSError("lost")
        return commit(*args, **kwargs)

    monkeypatch.setattr(VersionedTable, "commit", dies)
    result = run_ledger(spark, job, target, "j", folder)
    assert (result.status, result.success_rows) == ("failed", 10) and ids(target.read(spark)) == good(12)
    monkeypatch.undo()
    # Another change keeps the half seen run as it is.
    target.append(spark.createDataFrame([(100, 1)], "id bigint, v int"))
    assert ids(target.read(spark)) == [*good(12), 100]
    result = run_ledger(spark, job, target, "j", folder)
    assert (result.status, result.success_rows, result.error_rows) == ("completed", 37, 3)
    assert ids(target.read(spark)) == [*good(40), 100] and len(target.manifest(spark).steps) == 1
    log = ledger(spark, target, "j").orderBy("version").collect()
    assert [r.batch for r in log] == list(range(20)) and [r.version for r in log] == [*range(1, 7), *range(8, 22)]
    made = target.replace(target.read(spark))
    assert made.steps == {} and ids(target.read(spark)) == [*good(40), 100]


def test_the_log_keeps_jobs_apart_and_names_as_they_are(spark, case, folder):
    job, target, own = case
    run_ledger(spark, job, target, 'a "b".c', own)
    run_ledger(spark, job, target, "z", f"{folder}/z")
    first, second = (ledger(spark, target, n).orderBy("version").collect() for n in ('a "b".c', "z"))
    assert [r.version for r in first] == list(range(1, 21)) and [r.version for r in second] == list(range(21, 41))
    assert ledger(spark, target, "none").count() == 0
    target.expire(spark, keep=3, least_age_s=0.0)
    assert [r.batch for r in ledger(spark, target, "z").orderBy("batch").collect()] == [17, 18, 19]


def test_the_log_is_read_by_tasks(spark, case, monkeypatch):
    job, target, folder = case
    run_ledger(spark, job, target, "j", folder)
    monkeypatch.setattr(VersionedTable, "manifest", lambda *a: pytest.fail("the driver reads every manifest"))
    found = ledger(spark, target, "j")
    assert found.dtypes == [("batch", "bigint"), ("total_rows", "bigint"), ("success_rows", "bigint"),
                            ("error_rows", "bigint"), ("state", "string"), ("version", "bigint")]
    assert found.count() == 20 and found.where("state = 'completed'").first().batch == 19


def test_manifests_without_steps_are_read(spark, folder):
    target = VersionedTable.create(spark, f"{folder}/t", "id bigint")
    target.append(spark.range(3))
    made = json.loads(target.manifest(spark).to_json())
    assert made.pop("steps") == {}
    made["version"] = 2
    assert create_once(spark, target._manifest_path(2), json.dumps(made))
    assert not create_once(spark, target._manifest_path(2), "{}") and ids(target.read(spark)) == [0, 1, 2]


def test_runs_cover_all_batches_once():
    for start, end in ((0, 0), (0, 1), (3, 20), (5, 5), (7, 1000)):
        runs = list(_runs(start, end))
        assert [b for r in runs for b in r] == list(range(start, end)) and len(runs) <= 12
    assert STEP.startswith("__")


def test_the_ledger_query_exports_several_files(spark, folder, monkeypatch):
    """Rows go through more than one task and one file, and lines are numbered across files."""
    spark.range(4000).selectExpr("(id * 7919) % 4000 as event_id", "1L as user_id", "'x' as event_type").write.parquet(
        f"{folder}/events.parquet")
    exported, export = [], jobs.export_csv
    monkeypatch.setattr(jobs, "export_csv", lambda df, path: exported.append(path) or export(df, path))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # the ranges of so small a table would be merged
    try:
        job, target, result = jobs._csv_ledger(spark, folder)
    finally:
        spark.conf.set(setting, "true")
    assert spark.read.text(exported[0]).select(F.input_file_name()).distinct().count() > 1
    lines = job.source.select("line", F.col("event_id.text").cast("long").alias("id")).orderBy("line").collect()
    assert [(r.line, r.id) for r in lines] == [(i + 2, i) for i in range(4000)]
    assert result.total_rows == 4000 and target.read(spark).count() == result.success_rows
