"""Predicates against the Python model: two-valued, also under NOT, also on native types."""

from datetime import date, datetime

import model
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rowferry import between, col, eq, in_, is_empty, like, ne
from rowferry.functions.exprs import Const, Scope
from rowferry.functions.predicates import Compare
from rowferry.types import values_of

OPS = ["==", "!=", ">", "<", ">=", "<="]


def holds(df, condition):
    """Row ids where the condition and where its negation hold."""
    own = values_of(df)
    scope = Scope("t", {"t": {n.lower(): v for n, v in own.items()}}, list(own.values()))
    yes = {r["i"] for r in df.where(condition.bind(scope)).select("i").collect()}
    no = {r["i"] for r in df.where((~condition).bind(scope)).select("i").collect()}
    return yes, no


def check(df, condition, truth):
    yes, no = holds(df, condition)
    want = {i for i, t in enumerate(truth) if t}
    assert yes == want
    assert no == set(range(len(truth))) - want


COLUMNS = {
    "string": [None, "", "  ", "5", " 5.0", "abc", "ABC ", "2026-01-02", "1e1", "nan", "Z"],
    "bigint": [None, 0, 5, -3, 10, 2**53],
    "double": [None, 0.0, -0.0, 5.0, 5.5, float("nan"), float("inf")],
    "boolean": [None, True, False],
    "date": [None, date(2026, 1, 2), date(2025, 12, 31)],
    "timestamp_ntz": [None, datetime(2026, 1, 2), datetime(2026, 1, 2, 0, 0, 0, 500000),
                      datetime(2026, 1, 1, 23, 59, 59), datetime(2026, 1, 3, 1)],
}
CONSTANTS = [None, "", "5", "5.0", " abc", "2026-01-02", "2026-01-02 00:00:00", 5, 5.0, 5.5, True, float("nan"),
             date(2026, 1, 2), datetime(2026, 1, 2)]


@pytest.mark.parametrize("dtype", COLUMNS)
def test_comparisons_with_constants(spark, dtype):
    values = COLUMNS[dtype]
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {dtype}").cache()
    own = values_of(df)
    scope = Scope("t", {"t": {n: v for n, v in own.items()}}, list(own.values()))
    from pyspark.sql import functions as F

    tests, truths = [], []
    for c in CONSTANTS:
        for op in OPS:
            for left, right, flip in ((col("x"), Const(c), False), (Const(c), col("x"), True)):
                condition = Compare(left, op, right)
                for want in (True, False):
                    # A filter keeps what is true; NULL counts as false.
                    tests.append(F.coalesce(condition.bind(scope, want), F.lit(False)).alias(f"t{len(tests)}"))
                    truths.append((c, op, flip, want))
    rows = df.select("i", *tests).orderBy("i").collect()
    for k, (c, op, flip, want) in enumerate(truths):
        for row, v in zip(rows, values):
            expected = model.compare(c, op, v) if flip else model.compare(v, op, c)
            assert row[f"t{k}"] == (expected == want), (v, op, c, flip, want)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(
    st.one_of(st.none(), st.text(alphabet=" aB15.-e", max_size=4)),
    st.one_of(st.none(), st.text(alphabet=" aB15.-e", max_size=4))), min_size=1, max_size=120))
def test_text_columns_match_model(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for op in OPS:
        check(df, Compare(col("a"), op, col("b")), [model.compare(a, op, b) for a, b in pairs])


LIKES = [("hello", "h%o", True), ("hello", "%ell%", True), ("hello", "h_llo", True), ("Hello", "h%", True),
         ("abc", "abc", True), ("abc", "%", True), ("abc", "a%c", True), ("hello", "h_o", False),
         ("abc", "abcd", False), ("abc", "b%", False), ("a\\b", "a\\_", True), ("a\\b", "a\\b", True),
         (None, "%", True), (None, "", True), ("a\nb", "a%b", True), ("中文字", "中__", True), (".+", "a%", False)]


def test_like_constant_and_column_patterns(spark):
    df = spark.createDataFrame([(i, v, p) for i, (v, p, _) in enumerate(LIKES)], "i int, v string, p string")
    check(df, like("v", col("p")), [want for *_, want in LIKES])
    for v, p, want in LIKES:
        assert model.like(v, p) == want
        check(spark.createDataFrame([(0, v)], "i int, v string"), like("v", p), [want])


def test_in_between_empty_and_trees(spark):
    vs = [None, "", " a ", "B", "5", "7.5", "x"]
    df = spark.createDataFrame(list(enumerate(vs)), "i int, v string")
    check(df, in_("v", ["A", 5, None]), [v is not None and model.key(v) in ("a", "5") for v in vs])
    check(df, in_("v", []), [False] * len(vs))
    check(df, between("v", 5, "8"), [model.compare(v, ">=", 5) and model.compare(v, "<=", "8") for v in vs])
    check(df, is_empty("v"), [v is None or not v.strip() for v in vs])
    tree = (eq("v", "a") | ne("v", "b")) & ~is_empty("v")
    check(df, tree, [(model.key(v) == "a" or model.key(v) != "b") and bool(v and v.strip()) for v in vs])


def test_same_type_filters_reach_the_scan(spark, folder):
    spark.range(10).selectExpr(
        "id", "cast(id as int) as n", "timestamp_ntz'2026-01-01' as t").write.parquet(folder + "/t")
    df = spark.read.parquet(folder + "/t")
    own = values_of(df)
    scope = Scope("t", {"t": own}, [])
    cond = eq("id", 5) & ~eq("n", 3) & ~(Compare(col("t"), ">", Const("2026-01-05")))
    plan = df.where(cond.bind(scope))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("EqualNullSafe(id,5)", "EqualNullSafe(n,3)", "LessThan(t,"):
        assert part in pushed or part.replace("EqualNullSafe", "EqualTo") in pushed, pushed[:400]
