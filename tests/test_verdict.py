"""Nothing is lost or destroyed: rows without a key, and targets that a snapshot reads."""

import pytest
from pyspark.sql import functions as F

from rowferry import Work, col, eq, lit, run_works
from rowferry.errors import ConfigError
from rowferry.operators.merge import first_wins
from rowferry.scratch import materialize
from rowferry.sources.sinks import publish_snapshot


def test_tied_rows_without_a_key_all_stay(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), (None, 1), ("a", 2), ("a", 1)], "k string, ord int")
    kept = first_wins(rows, [F.col("k")], [F.col("ord")]).collect()
    assert sorted(map(str, map(tuple, kept))) == ["('a', 1)"] + ["(None, 1)"] * 3


def test_snapshot_of_its_own_target_is_refused(spark, folder):
    path = f"{folder}/target"
    spark.range(3).write.parquet(path)
    grown = spark.read.parquet(path).union(spark.range(1))
    with pytest.raises(ConfigError):
        publish_snapshot(grown, path)
    publish_snapshot(materialize(grown, "staged"), path)
    assert spark.read.parquet(path).count() == 4


@pytest.mark.parametrize("wanted, label", [("b", "last"), ("none", None)])
def test_lookup_by_a_constant_alone_joins_nothing(spark, wanted, label):
    source = spark.range(3).toDF("id")
    table = spark.createDataFrame([("b", 1, "first"), ("B", 2, "last"), (None, 3, "x")], "k string, o int, label string")
    target = spark.createDataFrame([], "id bigint, label string")
    work = (
        Work("w").source(source, "s", order_by="id", row="id").lookup(table, "t", [(lit(wanted), "t.k")], order_by="o")
        .into("out").add({"id": col("s.id"), "label": col("t.label")})
    )
    plan = work.plan({"out": target})
    inserts = plan.inserts()
    assert [tuple(r) for r in inserts.orderBy("id").collect()] == ([(i, label) for i in range(3)] if label else [])
    assert plan.rejects().count() == (0 if label else 3)
    shown = inserts._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown


def test_columns_may_be_named_like_helpers(spark):
    target = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k0 bigint, v string, e0 string")
    source = spark.createDataFrame([(1, "n")], "k0 bigint, v string")
    work = (
        Work("w").source(source, "s", order_by="k0", row="k0").into("t", "t").on(eq("t.k0", col("s.k0")))
        .matched_update({"v": col("s.v"), "e0": lit("new")})
    )
    got = run_works(spark, [work], {"t": target}).tables["t"]
    assert sorted(map(tuple, got.collect())) == [(1, "n", "new"), (2, "b", "old")]
