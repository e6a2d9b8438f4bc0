"""Headline timings. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
input and cores. Every query runs once to warm up and then three times; the
median counts. Results go to Spark's no-op sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from queries import QUERIES  # noqa: E402
from queries.registry import table  # noqa: E402
from rowferry import Kind, MappingJob, Rule, VersionedTable, Work, col, run_mapping, run_works, session  # noqa: E402
from rowferry.operators.mapping import apply_rules  # noqa: E402
from rowferry.operators.numbering import batch_no, with_row_no  # noqa: E402
from rowferry.scratch import scratch_path  # noqa: E402
from rowferry.sources.files import read_csv  # noqa: E402
from rowferry.sources.sinks import append_rows, export_csv  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def registered(name):
    return lambda spark: noop(QUERIES[name](spark, SF_DIR))


def text_lines(spark):
    """lineitem with every column as text.

    The given file has one row group, which one task reads; rows are spread over
    the cores first, as the row groups of a large table would be.
    """
    lines = table(spark, SF_DIR, "lineitem").repartition(int(CPUS))
    return lines.select(*[F.col(c).cast("string").alias(c) for c in lines.columns])


LINE_KINDS = [Kind.INTEGER] * 4 + [Kind.FLOAT] * 4 + [Kind.TEXT] * 2 + [Kind.DATETIME]


def line_rules(spark):
    names = table(spark, SF_DIR, "lineitem").columns
    return [Rule(i, n, n, k, null_allowed=False) for i, (n, k) in enumerate(zip(names, LINE_KINDS))]


def convert_lineitem_text(spark):
    noop(apply_rules(text_lines(spark), line_rules(spark), None))


def mapping_job_lineitem(spark):
    """Convert, count, write good rows: a whole job with numbered rows."""
    job = MappingJob(
        text_lines(spark).withColumn("row", F.monotonically_increasing_id()), line_rules(spark),
        order_by=[], row="row",
    )
    run_mapping(job, scratch_path(spark, "bench-mapping"))


def write_lineitem(spark):
    append_rows(table(spark, SF_DIR, "lineitem"), scratch_path(spark, "bench-sink"))


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def number_lineitem(spark):
    numbered = with_row_no(table(spark, SF_DIR, "lineitem"), LINE_ORDER)
    noop(numbered.withColumn("batch", batch_no(F.col("row_no"), 1, 5000)))


def work_rejects_lineitem(spark):
    """A work into a versioned table whose types reject some rows, which are numbered."""
    store = VersionedTable.create(spark, scratch_path(spark, "bench-store"), "part smallint, price decimal(7,2)")
    work = (
        Work("narrow").source(table(spark, SF_DIR, "lineitem"), "l", order_by=LINE_ORDER).into("t")
        .add({"part": col("l.l_partkey"), "price": col("l.l_extendedprice")})
    )
    noop(run_works(spark, [work], {"t": store}).rejects)


def main():
    cores = int(CPUS)
    spark = session(
        "bench", f"local[{cores}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(cores),
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: table(spark, SF_DIR, t).count() for t in ("lineitem", "orders", "events", "customer")}

    csv = scratch_path(spark, "bench-csv")
    export_csv(table(spark, SF_DIR, "lineitem").repartition(cores), csv)

    cases = {
        "read_csv_lineitem": (lambda s: noop(read_csv(s, csv)), "lineitem"),
        "convert_lineitem_text": (convert_lineitem_text, "lineitem"),
        "mapping_job_lineitem": (mapping_job_lineitem, "lineitem"),
        "write_lineitem": (write_lineitem, "lineitem"),
        "work_rejects_lineitem": (work_rejects_lineitem, "lineitem"),
        "number_and_batch_lineitem": (number_lineitem, "lineitem"),
        **{n: (registered(n), t) for n, t in {
            "gen_sha256": "lineitem", "template_concat": "lineitem", "filter_between": "lineitem",
            "filter_compare_native": "orders", "lookup_inner": "orders", "lookup_chain": "orders",
            "lookup_rejects": "orders", "lookup_last_wins": "orders", "convert_rows": "events",
            "convert_rejects": "events", "merge_upsert": "customer", "merge_delete": "customer",
            "multi_work": "customer",
        }.items()},
    }
    seconds, rates = {}, {}
    for name, (run, counted) in cases.items():
        run(spark)
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run(spark)
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        rates[name] = round(rows[counted] / seconds[name])
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_second": rates, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cores,
    }))


if __name__ == "__main__":
    main()
