"""Versioned tables, stored types and affected rows."""

import os

import pytest
from pyspark.sql import types as T

from rowferry import ConfigError, ConflictError, SourceError, VersionedTable, Work, col, run_works
from rowferry.sources.sinks import append_rows
from rowferry.sources import versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, folder):
    table = VersionedTable.create(spark, f"{folder}/t", "id bigint, name string, size smallint")
    table.append(spark.createDataFrame([(1, "a", 10), (2, "b", 20), (2, "bb", 21)], "id int, name string, size int"))
    return table


def test_versions_are_read_whole(spark, store):
    first = store.read(spark)
    store.append(spark.createDataFrame([("c", 3)], "NAME string, id bigint"))
    assert rows(store.read(spark)) == [(1, "a", 10), (2, "b", 20), (2, "bb", 21), (3, "c", None)]
    store.replace(store.read(spark).where("id = 2"))  # a frame that reads the table
    assert rows(store.read(spark)) == [(2, "b", 20), (2, "bb", 21)]
    assert rows(store.read(spark, 1)) == rows(first) == [(1, "a", 10), (2, "b", 20), (2, "bb", 21)]
    assert rows(store.read(spark, 0)) == []
    assert [r.change for r in store.history(spark).orderBy("version").collect()] == ["create", "append", "append", "replace"]
    assert store.read(spark).schema == store.manifest(spark).schema


def test_the_second_of_two_writers_is_refused(spark, store):
    base = store.manifest(spark)
    one, other = (spark.createDataFrame([(i, "x", 1)], "id bigint, name string, size smallint") for i in (8, 9))
    store.append(one, base)
    with pytest.raises(ConflictError):
        store.append(other, base)
    assert 9 not in [r.id for r in store.read(spark).collect()] and store.versions(spark) == [0, 1, 2]
    with pytest.raises(ConflictError):
        VersionedTable.create(spark, store.path, "id bigint")


def test_a_writer_that_dies_before_the_manifest_leaves_the_old_version(spark, store, monkeypatch):
    before = rows(store.read(spark))

    def dies(*_):
        raise OSError("no space left")

    monkeypatch.setattr(versions, "create_once", dies)
    with pytest.raises(OSError):
        store.replace(store.read(spark).limit(0))
    work = Work("w").source(store.read(spark), "s", order_by="id", row="id").into("t").add({"id": col("s.id")})
    result = run_works(spark, [work], {"t": store})
    assert result.status == "failed" and "no space left" in result.failure
    monkeypatch.undo()
    assert rows(store.read(spark)) == before and store.versions(spark) == [0, 1]
    assert store.expire(spark, least_age_s=0) == 2  # both data folders without a version
    assert rows(store.read(spark)) == before


def test_expired_versions_are_gone(spark, store):
    for i in range(3):
        store.replace(spark.createDataFrame([(i, "n", i)], "id bigint, name string, size int"))
    assert store.expire(spark, keep=2, least_age_s=3600) == 0
    assert store.versions(spark) == [3, 4]
    assert store.expire(spark, keep=1, least_age_s=0) == 3
    assert rows(store.read(spark)) == [(2, "n", 2)]
    with pytest.raises(SourceError):
        store.read(spark, 3)
    assert not [f for f in os.listdir(f"{store.path}/_versions") if "draft" in f]


def test_unknown_columns_and_unfit_values_change_nothing(spark, store):
    with pytest.raises(ConfigError):
        store.append(spark.createDataFrame([(1, 2)], "id bigint, colour int"))
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        store.append(spark.createDataFrame([(1, 1 << 20)], "id bigint, size bigint"))
    assert store.versions(spark) == [0, 1]
    with pytest.raises(SourceError):
        VersionedTable(f"{store.path}/none").read(spark)


def test_works_write_version_by_version(spark, store):
    source = spark.createDataFrame([(2, "new", 5), (7, "seven", 7), (8, "eight", 40_000)], "id bigint, name string, size bigint")
    upsert = (
        Work("upsert").source(source, "s", order_by="id", row="id").into("t", "t").on([("s.id", "t.id")])
        .not_matched_add({"id": col("s.id"), "name": col("s.name"), "size": col("s.size")})
        .matched_update({"name": col("s.name"), "size": col("s.size")})
    )
    drop = Work("drop").source(source, "s", order_by="id", row="id").into("t", "t").on([("s.id", "t.id")]).matched_delete()
    result = run_works(spark, [upsert, drop], {"t": store})
    assert result.status == "completed" and result.versions == {"t": 3} and result.elapsed_seconds > 0
    first, second = result.works
    assert (first.inserted, first.updated, first.rejected) == (1, 2, 1)  # one change, two target rows
    assert (second.deleted, second.rejected) == (3, 0)
    assert rows(store.read(spark, 2)) == [(1, "a", 10), (2, "new", 5), (2, "new", 5), (7, "seven", 7)]
    assert rows(store.read(spark)) == rows(result.tables["t"]) == [(1, "a", 10)]
    (reject,) = result.rejects.collect()
    assert (reject["row"], reject["column"]) == (8, "size") and "40000" in reject["reason"] and "smallint" in reject["reason"]


def test_a_work_fails_if_another_job_wrote_its_target(spark, store, monkeypatch):
    source = spark.createDataFrame([(5, "x")], "id bigint, name string")
    work = Work("w").source(source, "s", order_by="id", row="id").into("t").add({"id": col("s.id"), "name": col("s.name")})
    write = VersionedTable.write_part
    monkeypatch.setattr(VersionedTable, "write_part", lambda self, df, schema: (
        monkeypatch.undo(), store.replace(store.read(spark).limit(1)), write(self, df, schema))[2])
    result = run_works(spark, [work], {"t": store})
    assert result.status == "failed" and "first" in result.failure and result.success_rows == 0
    assert store.read(spark).count() == 1


def test_values_that_do_not_fit_are_rejected(spark):
    source = spark.createDataFrame(
        [(1, 127, 1e38, 9.994, "four"), (2, 128, 1.0, 1.0, "x"), (3, -129, 1.0, 1.0, "x"), (4, 1, 1e39, 1.0, "x"),
         (5, 1, float("inf"), 9.995, "x"), (6, None, None, None, None), (7, 1, 1.0, -9.996, "x"), (8, 1, 1.0, 1.0, "fives"),
         (9, 1, float("nan"), 0.125, "漢字漢字")],
        "id bigint, a bigint, b double, c double, d string",
    )
    schema = T.StructType.fromDDL("id int, a tinyint, b float, c decimal(3,2), d string")
    schema["d"].metadata["__CHAR_VARCHAR_TYPE_STRING"] = "char(4)"
    target = spark.createDataFrame([], schema)
    names = ["id", "a", "b", "c", "d"]
    work = Work("w").source(source, "s", order_by="id", row="id").into("t").add({n: col(f"s.{n}") for n in names})
    result = run_works(spark, [work], {"t": target})
    assert {r["row"]: r["column"] for r in result.rejects.collect()} == {2: "a", 3: "a", 4: "b", 5: "c", 7: "c", 8: "d"}
    kept = {r.id: r for r in result.tables["t"].collect()}
    assert sorted(kept) == [1, 6, 9] and str(kept[1].c) == "9.99" and str(kept[9].c) == "0.13" and kept[6].b is None
    assert (result.success_rows, result.error_rows) == (3, 6)


def test_updates_are_checked_too(spark):
    source = spark.createDataFrame([(1, 1000), (2, 5)], "id bigint, v bigint")
    target = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, v tinyint")
    work = Work("w").source(source, "s", order_by="id", row="id").into("t", "t").on([("s.id", "t.id")]).matched_update({"v": col("s.v")})
    result = run_works(spark, [work], {"t": target})
    assert rows(result.tables["t"]) == [(1, 1), (2, 5)] and (result.success_rows, result.error_rows) == (1, 1)


def test_lookup_duplicates_are_reported(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, k string")
    side = spark.createDataFrame([(1, "A"), (2, " a"), (3, "b"), (4, None)], "n bigint, k string")
    target = spark.createDataFrame([], "id bigint, n bigint")
    work = (
        Work("w").source(source, "s", order_by="id", row="id").lookup(side, "l", [("s.k", "l.k")], order_by="n")
        .into("t").add({"id": col("s.id"), "n": col("l.n")})
    )
    result = run_works(spark, [work], {"t": target})
    assert rows(result.lookup_duplicates()) == [("w", "l", 2, 1)]


def test_folder_keeps_its_types(spark, folder):
    path = f"{folder}/typed"
    append_rows(spark.createDataFrame([(1, "x")], "k int, p string"), path, ["p"])
    append_rows(spark.createDataFrame([(2, "01")], "K bigint, p string"), path, ["p"])
    read = spark.read.parquet(path)
    assert dict(read.dtypes)["k"] == "int" and read.count() == 2
    assert any(d == "p=01" for d in os.listdir(path))
    with pytest.raises(ConfigError):
        append_rows(spark.createDataFrame([(2, "y", 1)], "k int, p string, q int"), path, ["p"])
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        append_rows(spark.createDataFrame([(1 << 40, "x")], "k bigint, p string"), path, ["p"])
    assert spark.read.parquet(path).count() == 2
