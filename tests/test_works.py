"""Works end to end: lookups, generators, templates, merging, several works, validation."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rowferry import ConfigError, Gen, Work, col, concat, eq, like, lit, not_empty, run_works, template
from rowferry.functions.exprs import Template
from rowferry.functions.generators import JobClock
from rowferry.sources.files import read_csv


def write(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_lookup_from_csv_ignores_case(spark, folder):
    path = write(folder, "buoys.csv", "Buoy,station\nN7,Skagen\nS2,unknown\nW4,fanoe\n")
    buoys = read_csv(spark, path, row_no="line")
    stations = spark.createDataFrame([(70, "SKAGEN"), (40, "Fanoe"), (10, "Ribe")], "Nr bigint, station string")
    target = spark.createDataFrame([], "StationNr int, Buoy string, Kind string")
    work = (
        Work("place").source(buoys, "buoys", order_by="line", row="line")
        .lookup(stations, "st", eq("buoys.station", col("st.station")), order_by="Nr")
        .into("placed")
        .add({"StationNr": col("st.[Nr]"), "Buoy": col("BUOYS.buoy"), "Kind": "drifting"})
    )
    result = run_works(spark, [work], {"placed": target})
    assert (result.status, result.total_rows, result.success_rows, result.error_rows) == ("completed", 3, 2, 1)
    assert rows(result.tables["placed"], "StationNr") == [(40, "W4", "drifting"), (70, "N7", "drifting")]
    (reject,) = result.report().collect()
    assert (reject["row"], reject["column"]) == (3, "st") and reject["reason"].endswith("unknown")


def test_generators_templates_and_nulls(spark, folder):
    path = write(folder, "tides.csv", "port,remark\nEsbjerg,spring\nHavneby,\n")
    source = read_csv(spark, path, row_no="line")
    depth = spark.createDataFrame([("Esbjerg", 9), ("Havneby", 4)], "port string, metres bigint")
    target = spark.createDataFrame(
        [], "tag string, note string, id string, guid string, hash string, made string, at timestamp_ntz")
    clock = JobClock(datetime(2031, 2, 3, 4, 5, 6, 7000, timezone.utc))
    work = (
        Work("w").source(source, order_by="line", row="line")
        .lookup(depth, "d", [("port", "d.port")], order_by="port").into("out")
        .add({"tag": template("{port} at {d.metres} m"), "note": concat("tide: ", col("remark")),
              "id": Gen("ULID"), "guid": Gen("GUID"), "hash": Gen("SHA256"),
              "made": Gen("DateTime(Text)"), "at": Gen("DateTime")})
    )
    table = run_works(spark, [work], {"out": target}, clock).tables["out"]
    east, west = table.orderBy("tag").collect()
    assert (east["tag"], east["note"], west["tag"], west["note"]) == (
        "Esbjerg at 9 m", "tide: spring", "Havneby at 4 m", "tide: ")
    assert [r["id"] for r in table.orderBy("tag").collect()] == [east["id"], west["id"]]  # ids exist once
    assert east["id"] != west["id"] and len(east["id"]) == len(west["id"]) == 26
    assert (len(west["guid"]), len(west["hash"])) == (36, 64)
    import hashlib
    assert east["hash"] == hashlib.sha256("2\x1fEsbjerg\x1fspring".encode()).hexdigest()
    assert east["made"] == west["made"] == "2031-02-03 04:05:06"
    assert west["at"] == datetime(2031, 2, 3, 4, 5, 6, 7000)


def test_ulid_orders_by_time(spark):
    def one(ms):
        clock = JobClock(datetime.fromtimestamp(ms / 1000, timezone.utc))
        from rowferry.functions.generators import ulid
        return spark.range(1).select(ulid(clock)).first()[0]

    assert one(1_000)[:10] < one(2_000)[:10] == "00000001YG"


def test_template_parsing():
    assert template("no holes {{x}}") == lit("no holes {x}")
    assert isinstance(template("{a.[b c]}{Gen.Date}{1.5}"), Template)
    with pytest.raises(ConfigError):
        template("open {a")
    with pytest.raises(ConfigError):
        template("close }")


TARGET = [(1, "a@x", "old", 1), (2, "B@X ", "old", 2), (3, None, "old", 3), (4, "d@x", "old", 4)]
SOURCE = [  # ord, email, label, n
    (1, "A@x", "u1", "10"), (2, "a@x ", "u2", "11"), (3, "a@X", "u3", "bad"), (4, "new@x", "n1", "bad"),
    (5, "NEW@x", "n2", "1"), (6, None, "k1", "1"), (7, "  ", "k2", "2"), (8, "b@x", "u4", "12"), (9, "z@x", "skip", "3"),
]


@pytest.fixture
def tables(spark):
    return {
        "t": spark.createDataFrame(TARGET, "id bigint, email string, label string, n int"),
        "s": spark.createDataFrame(SOURCE, "ord bigint, email string, label string, n string"),
    }


def merge(match="normalized"):
    return Work("m").source("s", "s", order_by="ord").where(~like("s.label", "skip")).into("t", "t").on(
        [("s.email", "t.email")], match=match)


def test_upsert(spark, tables):
    work = merge().matched_update({"label": col("s.label"), "n": col("s.n")}).not_matched_add(
        {"email": col("s.email"), "label": col("label"), "n": col("n")})
    result = run_works(spark, [work], tables)
    # u3 fails, so u2 is the last good update; the failing n1 still claims its key.
    assert rows(result.tables["t"], "id", "label") == [
        (None, None, "k1", 1), (None, "  ", "k2", 2), (1, "a@x", "u2", 11), (2, "B@X ", "u4", 12),
        (3, None, "old", 3), (4, "d@x", "old", 4)]
    assert sorted((r["row"], r["column"]) for r in result.rejects.collect()) == [(3, "n"), (4, "n")]
    assert (result.success_rows, result.error_rows, result.total_rows) == (5, 2, 9)


def test_lazy_plan_agrees_with_staged_run(spark, tables):
    work = merge().matched_update({"label": col("s.label"), "n": col("s.n")}).not_matched_add(
        {"email": col("s.email"), "label": col("label"), "n": col("n")})
    plan = work.plan(tables)
    run = run_works(spark, [work], tables)
    assert rows(plan.apply(), "id", "label") == rows(run.tables["t"], "id", "label")
    assert sorted(map(tuple, plan.rejects().collect())) == sorted(
        tuple(r)[1:] for r in run.rejects.collect())


def test_exact_match_and_delete(spark, tables):
    work = merge("exact").matched_update({"label": col("s.label")})
    assert [r[2] for r in rows(run_works(spark, [work], tables).tables["t"], "id")] == ["old"] * 4
    result = run_works(spark, [merge().matched_delete()], tables)
    assert [r[0] for r in rows(result.tables["t"], "id")] == [3, 4]
    assert result.success_rows == 2


def test_skip_and_constant_keys(spark, tables):
    skip = merge().matched_skip().not_matched_skip()
    assert rows(run_works(spark, [skip], tables).tables["t"], "id") == sorted(TARGET)
    work = Work("c").source("s", "s", order_by="ord").into("t", "t").on(
        eq("t.label", lit(" OLD")) & eq("s.email", col("t.email"))).matched_update({"label": "hit"})
    assert [r[2] for r in rows(run_works(spark, [work], tables).tables["t"], "id")] == ["hit", "hit", "old", "old"]


def test_later_works_see_earlier_writes(spark, tables):
    first = Work("1").source("s", "s", order_by="ord").where(eq("s.ord", 9)).into("t", "t").on(
        [("s.email", "t.email")]).not_matched_add({"id": 99, "email": col("s.email"), "label": "first"})
    second = Work("2").source("s", "s", order_by="ord").lookup("t", "l", [("s.email", "l.email")], how="left",
                                                              order_by="id").where(
        not_empty("l.id")).into("t", "t").on([("s.email", "t.email")]).matched_update({"label": template("seen {l.label}")})
    out = run_works(spark, [first, second], tables)
    assert (99, "z@x", "seen first", None) in rows(out.tables["t"], "id")
    assert [w.name for w in out.works] == ["1", "2"]


def test_failed_write_stops_the_job(spark, tables):
    small = spark.createDataFrame([], "n tinyint")
    bad = Work("bad").source("s", "s", order_by="ord").where(eq("s.ord", 1)).into("small").add({"n": 1000})
    tables["small"] = small
    worse = merge().matched_update({"label": "never"})
    result = run_works(spark, [Work("u").source("s", "s", order_by="ord").into("small", "k").on(
        [("s.ord", "k.n")]).not_matched_add({"n": 1}), worse], tables)
    assert result.status == "completed"
    # Values beyond the stored type are rejects, not a failed write.
    over = Work("over").source("s", "s", order_by="ord").into("t", "t").on([("s.email", "t.email")]).matched_update(
        {"n": lit(2**40)})
    result = run_works(spark, [over, bad], tables)
    assert (result.status, result.success_rows, result.error_rows) == ("completed", 0, 5)
    assert rows(result.tables["t"], "id") == sorted(TARGET)
    tables["s"] = tables["s"].withColumn("label", F.when(F.col("ord") < 9, F.col("label")).otherwise(F.raise_error(F.lit("boom"))))
    fails = Work("fails").source("s", "s", order_by="ord", row="ord").into("t", "t").add({"label": col("s.label")})
    result = run_works(spark, [fails, bad], tables)
    assert result.status == "failed" and "fails" in result.failure and not result.works


def test_zoned_targets_store_utc(spark):
    saved = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Taipei")
    try:
        src = spark.sql("select 1 as o, timestamp_ntz'2026-01-02 03:00:00' as at")
        target = spark.sql("select 0 as o, timestamp_seconds(0) as at")
        work = Work("w").source(src, order_by="o", row="o").into("t").add({"o": col("o"), "at": col("at")})
        out = work.plan({"t": target}).apply()
        assert [r[0] for r in out.select(F.unix_seconds("at")).orderBy("o").collect()] == [0, 1767322800]
    finally:
        spark.conf.set("spark.sql.session.timeZone", saved)


def test_lookup_semantics(spark):
    src = spark.createDataFrame([(1, 5, "x"), (2, 5, None), (3, 6, "y"), (4, None, "x")], "o bigint, k int, c string")
    lk = spark.createDataFrame([(1, "5", " X ", "first"), (2, "5.0", "x", "second"), (3, "5", "X", "last"),
                                (4, None, "x", "null"), (5, "6", "  ", "blank")], "o bigint, k string, c string, v string")
    target = spark.createDataFrame([], "o bigint, v string")
    def run(how, on):
        work = Work("w").source(src, "s", order_by="o").lookup(lk, "l", on, how=how, order_by="o").into("t").add(
            {"o": col("s.o"), "v": col("l.v")})
        plan = work.plan({"t": target})
        return rows(plan.inserts(), "o"), rows(plan.rejects(), "row")

    good, bad = run("inner", [("s.k", "l.k"), ("s.c", "l.c")])
    assert good == [(1, "last")]  # an integer matches the text of its digits, the last duplicate counts
    assert bad == [(2, "l", "查表 [l] 查無對應：5, "), (3, "l", "查表 [l] 查無對應：6, y"),
                   (4, "l", "查表 [l] 查無對應：, x")]
    good, bad = run("left", [("l.k", "s.k")])
    assert good == [(1, "last"), (2, "last"), (3, "blank"), (4, None)] and bad == []


def test_validation_starts_no_job(spark, tables):
    base = Work("w").source("s", "s", order_by="ord").into("t", "t")
    bad = [
        (lambda: Work("w").source("s", order_by="ord").into("t").add({}).validate(), "no column"),
        (lambda: Work("w").source("s").into("t").add({"n": 1}).validate(), "order_by"),
        (lambda: Work("w").source("s", order_by="ord").into("t").matched_delete().validate(), "merge key"),
        (lambda: Work("w").source("s", "s", order_by="ord").into("t").add({"n": col("q.n")}).validate(), "q"),
        (lambda: base.add({"n": col("s.nope")}).plan(tables), "nope"),
        (lambda: Work("w").source("s", "s", order_by="ord").into("t").add({"zz": 1}).plan(tables).inserts(), "zz"),
        (lambda: Work("w").lookup("t", "l", ~eq("a", col("l.b")), order_by="id"), "equalities"),
        (lambda: Work("w").lookup("t", "l", [("a", "b")], order_by="id"), "one of its columns"),
        (lambda: Work("w").source("s", "s", order_by="ord").lookup("t", "l", [("x.a", "l.id")], order_by="id")
            .into("t").add({"n": 1}).validate(), "not known"),
    ]
    for call, words in bad:
        with pytest.raises(ConfigError, match=words):
            call()


def test_hot_keys_are_split(spark):
    """A key with a third of all rows: the join is planned so that its partition can be split."""
    saved = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32KB")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        src = spark.range(0, 60000, 1, 6).selectExpr(
            "id as o", "case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as k", "uuid() as pad")
        lk = spark.range(0, 60000, 1, 4).selectExpr("id as k", "concat('v', id) as v")
        target = spark.createDataFrame([], "o bigint, v string, pad string")
        work = Work("w").source(src, "s", order_by="o", row="o").lookup(
            lk, "l", [("s.k", "l.k")], how="left", order_by="k").into("t").add(
            {"o": col("s.o"), "v": col("l.v"), "pad": col("s.pad")})
        out = work.plan({"t": target}).inserts()
        got = out.groupBy("v").agg(F.count("*").alias("n"), F.max("pad"))
        top = {r["v"]: r["n"] for r in got.orderBy(F.desc("n")).limit(3).collect()}
        assert top["v7"] == 20000 and top[None] == 20000
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
