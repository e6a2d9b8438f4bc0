"""Conversion matrix, display text, keys, sniffing and type votes."""

from datetime import date, datetime

import model
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowferry.functions.convert import convert
from rowferry.functions.sniff import infer_types, sniff_cells
from rowferry.functions.text import display, float_text, key, num, utrim
from rowferry.types import Kind, Value, from_native_type, normalize_types, values_of

SPARK = {Kind.INTEGER: "bigint", Kind.FLOAT: "double", Kind.TEXT: "string", Kind.BOOL: "boolean",
         Kind.DATETIME: "timestamp_ntz", Kind.DATE: "date"}
NOON = datetime(2026, 6, 12, 13, 30)
DAY = date(2026, 6, 12)

CASES = [
    (Kind.FLOAT, 3.0, Kind.INTEGER, 3, None),
    (Kind.FLOAT, 3.5, Kind.INTEGER, None, "無法將 3.5 轉為整數（非整數或溢位）"),
    (Kind.FLOAT, 1e20, Kind.INTEGER, None, "無法將 100000000000000000000 轉為整數（非整數或溢位）"),
    (Kind.FLOAT, float("inf"), Kind.INTEGER, None, "無法將 inf 轉為整數（非整數或溢位）"),
    (Kind.TEXT, " 42 ", Kind.INTEGER, 42, None),
    (Kind.TEXT, "　+7\t", Kind.INTEGER, 7, None),
    (Kind.TEXT, "abc", Kind.INTEGER, None, "無法將「abc」解析為整數"),
    (Kind.TEXT, "42.0", Kind.INTEGER, None, "無法將「42.0」解析為整數"),
    (Kind.TEXT, "9223372036854775808", Kind.INTEGER, None, "無法將「9223372036854775808」解析為整數"),
    (Kind.TEXT, "4\x01", Kind.INTEGER, None, "無法將「4\x01」解析為整數"),
    (Kind.BOOL, True, Kind.INTEGER, 1, None),
    (Kind.INTEGER, 5, Kind.FLOAT, 5.0, None),
    (Kind.TEXT, "1e3", Kind.FLOAT, 1000.0, None),
    (Kind.TEXT, ".5", Kind.FLOAT, 0.5, None),
    (Kind.TEXT, "-Infinity", Kind.FLOAT, float("-inf"), None),
    (Kind.TEXT, "1.5d", Kind.FLOAT, None, "無法將「1.5d」解析為浮點數"),
    (Kind.TEXT, "0x1p3", Kind.FLOAT, None, "無法將「0x1p3」解析為浮點數"),
    (Kind.BOOL, True, Kind.FLOAT, None, "不支援 Some(Bool) → Float 的轉換"),
    (Kind.INTEGER, 7, Kind.TEXT, "7", None),
    (Kind.FLOAT, 1.0, Kind.TEXT, "1", None),
    (Kind.FLOAT, 1e21, Kind.TEXT, "1000000000000000000000", None),
    (Kind.BOOL, True, Kind.TEXT, "true", None),
    (Kind.DATETIME, datetime(2026, 1, 2, 3, 4, 5, 678), Kind.TEXT, "2026-01-02 03:04:05", None),
    (Kind.INTEGER, 1, Kind.BOOL, True, None),
    (Kind.INTEGER, 2, Kind.BOOL, None, "無法將 2 轉為布林（僅接受 0/1）"),
    (Kind.TEXT, " TRUE", Kind.BOOL, True, None),
    (Kind.TEXT, "yes", Kind.BOOL, None, "無法將「yes」解析為布林"),
    (Kind.FLOAT, 1.0, Kind.BOOL, None, "不支援 Some(Float) → Bool 的轉換"),
    (Kind.TEXT, "2026/06/12", Kind.DATE, DAY, None),
    (Kind.TEXT, "26-1-5", Kind.DATE, date(26, 1, 5), None),
    (Kind.TEXT, "2026-06-31", Kind.DATE, None, "無法將「2026-06-31」解析為日期"),
    (Kind.TEXT, "2026-06", Kind.DATE, None, "無法將「2026-06」解析為日期"),
    (Kind.TEXT, "not a date", Kind.DATE, None, "無法將「not a date」解析為日期"),
    (Kind.DATETIME, NOON, Kind.DATE, DAY, None),
    (Kind.DATE, DAY, Kind.DATETIME, datetime(2026, 6, 12), None),
    (Kind.TEXT, "2026-06-12T13:30:00", Kind.DATETIME, NOON, None),
    (Kind.TEXT, "2026/06/12 13:30", Kind.DATETIME, NOON, None),
    (Kind.TEXT, "2026/06/12T13:30:00", Kind.DATETIME, None, "無法將「2026/06/12T13:30:00」解析為日期時間"),
    (Kind.TEXT, "2026-06-12", Kind.DATETIME, datetime(2026, 6, 12), None),
    (Kind.TEXT, "2026-06-12 24:00", Kind.DATETIME, None, "無法將「2026-06-12 24:00」解析為日期時間"),
    (Kind.INTEGER, 1, Kind.DATE, None, "不支援 Some(Integer) → Date 的轉換"),
    (Kind.DATE, DAY, Kind.INTEGER, None, "不支援 Some(Date) → Integer 的轉換"),
    (Kind.TEXT, None, Kind.INTEGER, None, None),
]


def test_conversion_matrix(spark):
    for kind in Kind:
        cases = [c for c in CASES if c[0] is kind]
        for target in {c[2] for c in cases}:
            chosen = [c for c in cases if c[2] is target]
            df = spark.createDataFrame(
                [(i, c[1]) for i, c in enumerate(chosen)], f"i int, x {SPARK[kind]}"
            )
            value, reason = convert(Value(F.col("x"), kind), target)
            got = df.select("i", value.alias("v"), reason.alias("r")).orderBy("i").collect()
            for row, case in zip(got, chosen):
                assert (row["v"], row["r"]) == (case[3], case[4]), case


def test_utrim_knows_unicode_space(spark):
    df = spark.createDataFrame([("　\tx y\xa0\n",), ("",), (" ",), (None,), ("é",)], "s string")
    assert [r[0] for r in df.select(utrim(F.col("s"))).collect()] == ["x y", "", "", None, "é"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(
    st.floats(min_value=1e-3, max_value=1e15), st.floats(min_value=-1e6, max_value=1e6),
    st.sampled_from([0.0, -0.0, 1e21, 1e300, 1.5e-7, float("nan"), float("inf"), float("-inf")]),
), min_size=1, max_size=50))
def test_float_text_matches_model(spark, xs):
    # Where the JVM's own shortest digits differ from Python's, values must still agree.
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, t in zip(xs, [r[0] for r in df.select(float_text(F.col("x"))).collect()]):
        assert "e" not in t.lower() or t in ("inf", "-inf")
        assert t == model.display(x) or float(t) == x


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(
    st.none(), st.text(alphabet=" \taB1.e-+0", max_size=6), st.sampled_from(["inf", "NaN", "1e5", " 7 "]),
), min_size=1, max_size=60))
def test_keys_and_numbers_match_model(spark, xs):
    v = Value(F.col("x"), Kind.TEXT)
    df = spark.createDataFrame([(x,) for x in xs], "x string")
    for x, row in zip(xs, df.select(key(v).alias("k"), num(v).alias("n")).collect()):
        assert row["k"] == model.key(x)
        want = model.num(x)
        assert row["n"] == want or (want != want and row["n"] != row["n"])


def test_float_keys(spark):
    v = Value(F.col("x"), Kind.FLOAT)
    xs = [1.0, -0.0, 2.5, 2.0**60, 1e300]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(key(v)).collect()][:4] == ["1", "0", "2.5", str(2**60)]


SNIFFED = [
    ("42", "integer", "42"), ("+7", "integer", "7"), ("3.5", "float", "3.5"), ("1.0", "float", "1"),
    ("1e3", "float", "1000"), ("TRUE", "bool", "true"), ("", None, None), ("  ", None, None),
    ("007", "text", "007"), ("0", "integer", "0"), ("0.5", "float", "0.5"), ("-007", "integer", "-7"),
    ("2026-06-12", "date", "2026-06-12"), ("2026/06/12", "date", "2026-06-12"),
    ("2026-6-1", "date", "2026-06-01"), ("26-6-1", "text", "26-6-1"),
    ("2026-06-12 10:20", "datetime", "2026-06-12 10:20:00"), ("2026-02-30", "text", "2026-02-30"),
    ("inf", "text", "inf"), ("1e999", "text", "1e999"), (" x ", "text", "x"), (None, None, None),
    ("9223372036854775808", "float", "9223372036854775807"), ("true story", "text", "true story"),
]


def test_sniffing(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(SNIFFED)], "i int, c string")
    for row, (raw, kind, text) in zip(sniff_cells(df, ["c"]).orderBy("i").collect(), SNIFFED):
        got = (None, None) if row["c"] is None else tuple(row["c"])
        if raw == "9223372036854775808":
            assert got[0] == "float" and float(got[1]) == 2.0**63
        else:
            assert got == (kind, text), raw


def test_sniffed_cells_convert_after_typing(spark):
    df = sniff_cells(spark.createDataFrame([("1.0",), ("TRUE",), ("2026/06/12",), ("1e3",), ("007",)], "c string"))
    v = values_of(df)["c"]
    assert [r[0] for r in df.select(convert(v, Kind.TEXT)[0]).collect()] == [
        "1", "true", "2026-06-12", "1000", "007"]
    got = df.select(*[c.alias(n) for c, n in zip(convert(v, Kind.INTEGER), "vr")]).collect()
    assert [r["v"] for r in got] == [1, 1, None, 1000, 7]
    assert got[2]["r"] == "不支援 Some(Date) → Integer 的轉換"


def test_type_vote(spark):
    rows = [("1", "a", None, "2026-01-01", "x"), ("2.5", "b", "", "2026-01-01 10:00", "1")]
    df = sniff_cells(spark.createDataFrame(rows, "n string, t string, z string, d string, m string"))
    assert [(r["name"], r["inferred_type"]) for r in infer_types(df).collect()] == [
        ("n", "float"), ("t", "text"), ("z", None), ("d", "datetime"), ("m", "text")]


@pytest.mark.parametrize("native, kind", [
    ("BOOLEAN", "bool"), ("bit", "bool"), ("int4", "integer"), ("bigserial", "integer"), ("year", "integer"),
    ("interval", "integer"), ("numeric(10,2)", "float"), ("money", "float"), ("datetimeoffset", "text"),
    ("datetime2", "datetime"), ("timestamp_ntz", "datetime"), ("date", "date"), ("uuid", "text"),
])
def test_native_types(spark, native, kind):
    assert spark.range(1).select(from_native_type(native)).first()[0] == kind


def test_normalize_types(spark):
    df = spark.sql("""select cast(1 as tinyint) i, cast(1.5 as decimal(9,2)) d, timestamp_seconds(3600) z,
        cast('x' as binary) b, array(1,2) a, map('k', 1) m, interval '1' day iv, cast(1.5 as float) f""")
    out = normalize_types(df)
    assert [f.dataType.simpleString() for f in out.schema] == [
        "bigint", "double", "timestamp_ntz", "string", "string", "string", "string", "double"]
    assert out.first()[:6] == (1, 1.5, datetime(1970, 1, 1, 1), None, "[1,2]", '{"k":1}')


def test_display_of_cells(spark):
    df = sniff_cells(spark.createDataFrame([("1.50",)], "c string"))
    assert df.select(display(values_of(df)["c"])).first()[0] == "1.5"
