"""Numbering, batches, error policies, summaries, sinks, checkpointed batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.conversion import DIRTY_CTE, DIRTY_RULES, REJECTS_SQL, dirty_job
from queries.registry import query, table, view
from rowferry import ABORT_ON_FIRST, MappingJob, VersionedTable, Work, abort_on_error_rate, col, run_mapping, run_works
from rowferry.functions.exprs import Gen
from rowferry.operators.numbering import batch_no, with_row_no
from rowferry.plans.mapping_job import aborting_batch, batch_stats, policy_verdict
from rowferry.plans.result import SUMMARY_SCHEMA, reject_report
from rowferry.scratch import scratch_path
from rowferry.sources.files import read_csv
from rowferry.sources.sinks import append_rows, export_csv
from rowferry.streaming.batches import BatchJob, rejected_rows, run_batches, written_rows
from rowferry.streaming.ledger import ledger, run_ledger

D = ("dirty_events",)
GOOD_SQL = """select event_id as id, cast(trim(raw_int) as bigint) as n, raw_bool = 'TRUE' as flag,
    case raw_date when '2024/1/5' then timestamp '2024-01-05 00:00:00'
      when '2024-03-01 10:20' then timestamp '2024-03-01 10:20:00'
      else timestamp '2024-01-15 00:00:00' end as at from t where bad is null"""


@query(
    "row_numbers",
    """select 1 + row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_shipdate) as line, l_orderkey,
         cast(l_linenumber as bigint) as l_linenumber from lineitem""",
)
def row_numbers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
             "l_extendedprice", "l_shipdate"]
    numbered = with_row_no(lines.select(*order), order, first=2, name="line")
    return numbered.select("line", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))


@query(
    "batch_assignment",
    "select event_id, cast(floor((row_number() over (order by event_id) - 1) / 500) as bigint) as batch from events",
)
def batch_assignment(spark, sf_dir):
    numbered = with_row_no(table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    return numbered.select("event_id", batch_no(F.col("row_no"), 1, 500).alias("batch"))


STATS_SQL = """select cast(floor((row_no - 1) / 500) as bigint) as batch,
    count(*) filter (bad is null) as ok_rows, count(*) filter (bad is not null) as error_rows
    from t group by 1"""


@query("batch_stats", f"{DIRTY_CTE} {STATS_SQL}", D)
def batch_stats_query(spark, sf_dir):
    return batch_stats(dirty_job(spark, sf_dir).tagged(), 1, 500)


@query("policy_skip", f"{DIRTY_CTE} {GOOD_SQL}", D)
def policy_skip(spark, sf_dir):
    """Skip and report: good rows are written, bad ones reported."""
    result = run_mapping(dirty_job(spark, sf_dir), scratch_path(spark, "skip"))
    return result.tables["good"]


@query(
    "policy_abort_first",
    f"""{DIRTY_CTE}, stats as ({STATS_SQL}) select 'all_or_nothing' as mode, 'aborted' as status,
          cast(null as bigint) as batch where exists (select 1 from stats where error_rows > 0)
        union all select 'batches', 'aborted', min(batch) from stats where error_rows > 0""",
    D,
)
def policy_abort_first(spark, sf_dir):
    tagged = dirty_job(spark, sf_dir).tagged()
    whole = policy_verdict(tagged, ABORT_ON_FIRST).select(
        F.lit("all_or_nothing").alias("mode"), "status", F.lit(None).cast("bigint").alias("batch")
    )
    stop = aborting_batch(batch_stats(tagged, 1, 500), ABORT_ON_FIRST).select(
        F.lit("batches").alias("mode"),
        F.when(F.col("batch").isNull(), "completed").otherwise("aborted").alias("status"), "batch",
    )
    return whole.unionAll(stop)


@query(
    "policy_error_rate",
    f"""{DIRTY_CTE}, stats as ({STATS_SQL}),
        running as (select batch, sum(error_rows) over w as e, sum(ok_rows) over w as k, ok_rows,
          sum(error_rows) over w * 100.0 / (sum(error_rows) over w + sum(ok_rows) over w) as inclusive,
          sum(error_rows) over w * 100.0 / greatest(sum(error_rows) over w + sum(ok_rows) over w - ok_rows, 1) as late
          from stats window w as (order by batch rows unbounded preceding))
        select 'inclusive' as counting, 39 as limit_percent, min(batch) as batch from running where inclusive > 39
        union all select 'late', 40, min(batch) from running where late > 40
        union all select 'inclusive', 90, min(batch) from running where inclusive > 90""",
    D,
)
def policy_error_rate(spark, sf_dir):
    """First batch at which the running error rate is above the limit."""
    stats = batch_stats(dirty_job(spark, sf_dir).tagged(), 1, 500)
    frames = [
        aborting_batch(stats, abort_on_error_rate(limit, counting)).select(
            F.lit(counting).alias("counting"), F.lit(limit).alias("limit_percent"), "batch"
        )
        for counting, limit in (("inclusive", 39), ("late", 40), ("inclusive", 90))
    ]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


@query("reject_report", f'select * from ({REJECTS_SQL}) r order by row limit 1000', D)
def reject_report_query(spark, sf_dir):
    """A report shows the first 1000 rejects: the limit is the feature."""
    result = run_mapping(dirty_job(spark, sf_dir))
    return reject_report(result.rejects)


@query(
    "job_summary",
    f"""{DIRTY_CTE} select 'completed' as status, count(*) as total_rows,
          count(*) filter (bad is null) as success_rows, count(*) filter (bad is not null) as error_rows,
          cast(null as varchar) as failure from t""",
    D,
)
def job_summary(spark, sf_dir):
    result = run_mapping(dirty_job(spark, sf_dir), scratch_path(spark, "summary"))
    return result.summary(spark)


@query(
    "work_summary",
    """select 'completed' as status, count(*) as total_rows,
         count(*) filter (id is not null) as success_rows, count(*) filter (id is null) as error_rows,
         cast(null as varchar) as failure from orders left join accounts on o_custkey = id""",
    ("accounts",),
)
def work_summary(spark, sf_dir):
    """A staged run with generated ids: each row gets one id, counted after writing."""
    target = spark.createDataFrame([], "ulid string, order_id bigint, hash string")
    work = (
        Work("ids").source(table(spark, sf_dir, "orders"), "o", order_by="o_orderkey", row="o_orderkey")
        .lookup(view(spark, sf_dir, "accounts"), "a", [("o.o_custkey", "a.id")], order_by="id")
        .into("ids").add({"ulid": Gen("ULID"), "order_id": col("o.o_orderkey"), "hash": Gen("SHA256")})
    )
    result = run_works(spark, [work], {"ids": target})
    return spark.createDataFrame(
        [(result.status, result.total_rows, result.success_rows, result.error_rows, result.failure)],
        SUMMARY_SCHEMA,
    )


@query(
    "write_all_or_nothing",
    f"""{DIRTY_CTE} select 'under' as run, count(*) filter (bad is null) as written from t
        union all select 'over', 0 from t where bad is not null group by 1""",
    D,
)
def write_all_or_nothing(spark, sf_dir):
    """One run under its error limit writes all good rows, one over it writes nothing."""
    out = []
    for name, limit in (("under", 60.0), ("over", 5.0)):
        job = dirty_job(spark, sf_dir, policy=abort_on_error_rate(limit), write_mode="all_or_nothing")
        path = scratch_path(spark, name)
        result = run_mapping(job, path)
        rows = spark.read.parquet(path) if result.success_rows else result.tables["good"]
        out.append(rows.agg(F.count(F.lit(1)).alias("written")).select(F.lit(name).alias("run"), "written"))
    return out[0].unionAll(out[1])


@query("sink_table", "select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders")
def sink_table(spark, sf_dir):
    """Two appends to one table, read back."""
    path = scratch_path(spark, "sink")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    append_rows(orders.where("o_orderkey % 2 = 0"), path)
    append_rows(orders.where("o_orderkey % 2 = 1"), path)
    return spark.read.parquet(path)


@query(
    "export_csv",
    """select cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber,
         regexp_replace(cast(l_extendedprice as varchar), '[.]0$', '') as price,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as shipped,
         strftime(l_shipdate, '%Y-%m-%d') as day from lineitem""",
)
def export_csv_query(spark, sf_dir):
    """Exported text, read back raw."""
    path = scratch_path(spark, "export")
    export_csv(
        table(spark, sf_dir, "lineitem").selectExpr(
            "l_orderkey", "l_linenumber", "l_extendedprice price", "l_shipdate shipped",
            "cast(l_shipdate as date) day"),
        path,
    )
    return read_csv(spark, path, typed=False)


BATCH_ROWS_SQL = f"""{DIRTY_CTE} select 'row' as outcome, row_no, event_id as id from t where bad is null
    union all select 'reject', row_no, null from t where bad is not null"""


@query("batch_commit", BATCH_ROWS_SQL, D)
def batch_commit(spark, sf_dir):
    """Files in batches through a checkpointed stream; rows and rejects of all batches."""
    source, target = scratch_path(spark, "batches-in"), scratch_path(spark, "batches-out")
    numbered = with_row_no(view(spark, sf_dir, "dirty_events"), ["event_id"], name="line")
    numbered.repartitionByRange(8, "line").write.parquet(source)
    job = BatchJob(
        source, numbered.schema, [r for r in DIRTY_RULES], "line", target,
        scratch_path(spark, "batches-checkpoint"), files_per_batch=2,
    )
    run_batches(spark, job)
    good = written_rows(spark, job).select(
        F.lit("row").alias("outcome"), F.col("__row").alias("row_no"), "id"
    )
    bad = rejected_rows(spark, job).select(
        F.lit("reject").alias("outcome"), F.col("row").alias("row_no"), F.lit(None).cast("bigint").alias("id")
    )
    return good.unionAll(bad)


def _csv_ledger(spark, sf_dir):
    """dirty_events as CSV files of typed cells, committed in batches of 500 lines into a table."""
    source = scratch_path(spark, "ledger-csv")
    # One file for each range of keys, so that the files' order is the keys' order.
    export_csv(view(spark, sf_dir, "dirty_events").repartitionByRange("event_id").sortWithinPartitions("event_id"), source)
    job = MappingJob(
        read_csv(spark, source, row_no="line"), DIRTY_RULES, order_by=[], row="line", first_row=2, batch_size=500
    )
    target = VersionedTable.create(
        spark, scratch_path(spark, "ledger-target"), "id bigint, n bigint, flag boolean, at timestamp_ntz"
    )
    return job, target, run_ledger(spark, job, target, "load", scratch_path(spark, "ledger-job"), source)


CSV_CTE = """with l as (select *, row_number() over (order by event_id) + 1 as line from dirty_events),
    t as (select event_id, line, case when raw_int in ('abc', '1.5') then 'raw_int' when raw_bool = 'yes' then 'raw_bool'
      when raw_date = '2024-02-30' then 'raw_date' end as bad from l)"""


@query(
    "batch_commit_csv",
    f"""{CSV_CTE} select 'row' as outcome, cast(null as bigint) as line, event_id as id from t where bad is null
        union all select 'reject: ' || bad, line, null from t where bad is not null""",
    ("dirty_events",),
)
def batch_commit_csv(spark, sf_dir):
    """A CSV file with typed cells, committed batch by batch into a table: its rows, and the rejects by line."""
    _, target, result = _csv_ledger(spark, sf_dir)
    good = target.read(spark).select(F.lit("row").alias("outcome"), F.lit(None).cast("bigint").alias("line"), "id")
    bad = result.rejects.select(
        F.concat(F.lit("reject: "), "column"), F.col("row"), F.lit(None).cast("bigint")
    )
    return good.unionAll(bad)


@query(
    "batch_ledger",
    f"""{CSV_CTE}, b as (select (line - 2) // 500 as batch, count(*) as total_rows, count(*) filter (bad is null) as success_rows,
          count(*) filter (bad is not null) as error_rows from t group by 1)
        select batch, total_rows, success_rows, error_rows,
          case when batch = (select max(batch) from b) then 'completed' else 'running' end as state, batch + 1 as version from b""",
    ("dirty_events",),
)
def batch_ledger(spark, sf_dir):
    """The log that the commits of a batch-wise job leave in the target's versions."""
    _, target, _ = _csv_ledger(spark, sf_dir)
    return ledger(spark, target, "load")
