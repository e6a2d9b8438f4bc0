"""Predicates on match keys: two-valued, case- and padding-blind, numbers by value."""

from __future__ import annotations

from queries.registry import query, table, view
from rowferry import (
    between,
    col,
    eq,
    ge,
    gt,
    in_,
    is_empty,
    le,
    like,
    lt,
    ne,
    not_between,
    not_empty,
    not_in,
    not_like,
)
from rowferry.functions.exprs import Scope
from rowferry.types import values_of

NICK = "coalesce(nullif(lower(trim(nick)), ''), '∅')"


def filtered(df, condition, *columns):
    own = values_of(df)
    scope = Scope("t", {"t": {n.lower(): v for n, v in own.items()}}, list(own.values()))
    return df.where(condition.bind(scope)).select(*columns)


def _accounts(name, sql_condition, condition):
    @query(name, f"select id, email, nick from accounts where {sql_condition}", ("accounts",))
    def run(spark, sf_dir):
        return filtered(view(spark, sf_dir, "accounts"), condition, "id", "email", "nick")

    return run


_accounts("filter_eq", f"{NICK} = 'building'", eq("nick", " BUILDING "))
_accounts("filter_eq_null", "nick is null or trim(nick) = ''", eq("nick", None))
_accounts("filter_ne", f"{NICK} <> 'building'", ne("nick", "Building"))
_accounts("filter_is_empty", "nick is null or trim(nick) = ''", is_empty("nick"))
_accounts("filter_not_empty", "nick is not null and trim(nick) <> ''", not_empty("nick"))
_accounts("filter_in", f"{NICK} in ('building', 'machinery')", in_("nick", ["BUILDING", "machinery "]))
_accounts("filter_not_in", f"{NICK} not in ('building', 'machinery')",
          not_in("nick", ["building", "Machinery", None]))
_accounts("filter_like", "email ilike '%customer#0%7_' ", like("email", "%CUSTOMER#0%7_"))
_accounts("filter_not_like", "not coalesce(nick, '') ilike 'B%'", not_like("nick", "b%"))
_accounts(
    "filter_bool_tree",
    f"""not ({NICK} = 'building' or balance > 5000) and (nation_id in (1, 2, 3) or email ilike '%9')""",
    ~(eq("nick", "building") | gt("balance", 5000)) & (in_("nation_id", [1, 2, 3]) | like("email", "%9")),
)


@query(
    "filter_compare",
    """select event_id, raw_int from dirty_events
       where case when regexp_full_match(trim(raw_int), '[0-9]+([.][0-9]+)?')
                  then cast(trim(raw_int) as double) >= 500 and cast(trim(raw_int) as double) < 7000
                  else lower(trim(raw_int)) >= '500' and lower(trim(raw_int)) < '7000' end""",
    ("dirty_events",),
)
def filter_compare(spark, sf_dir):
    """Text that reads as a number compares by value, other text by its key."""
    events = view(spark, sf_dir, "dirty_events")
    return filtered(events, ge("raw_int", 500) & lt("raw_int", "7000"), "event_id", "raw_int")


@query(
    "filter_compare_native",
    """select o_orderkey, o_totalprice from orders
       where o_totalprice > 250000 and o_custkey <= 700
         and o_orderdate >= timestamp '1996-01-01' and not o_orderdate > timestamp '1997-06-30'""",
)
def filter_compare_native(spark, sf_dir):
    """Same-type comparisons and text dates stay native and reach the scan."""
    return filtered(
        table(spark, sf_dir, "orders"),
        gt("o_totalprice", 250000) & le("o_custkey", 700) & ge("o_orderdate", "1996-01-01")
        & ~gt("o_orderdate", "1997-06-30 00:00:00"),
        "o_orderkey", "o_totalprice",
    )


@query(
    "filter_columns",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_linenumber = l_quantity or l_suppkey > l_partkey",
)
def filter_columns(spark, sf_dir):
    """Both sides columns, of different types."""
    return filtered(
        table(spark, sf_dir, "lineitem"),
        eq("l_linenumber", col("l_quantity")) | gt("l_suppkey", col("l_partkey")),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    ).selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("filter_between", "select l_orderkey, l_quantity from lineitem where l_quantity between 10 and 20")
def filter_between(spark, sf_dir):
    return filtered(table(spark, sf_dir, "lineitem"), between("l_quantity", 10, 20),
                    "l_orderkey", "l_quantity")


@query(
    "filter_not_between",
    """select event_id, raw_int from dirty_events
       where not coalesce(case when regexp_full_match(trim(raw_int), '[0-9]+([.][0-9]+)?')
                  then cast(trim(raw_int) as double) between 100 and 9000
                  else lower(trim(raw_int)) between '100' and '9000' end, false)""",
    ("dirty_events",),
)
def filter_not_between(spark, sf_dir):
    events = view(spark, sf_dir, "dirty_events")
    return filtered(events, not_between("raw_int", 100, 9000), "event_id", "raw_int")
