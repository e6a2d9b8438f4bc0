"""Lookups: inner with rejects, left, last-wins, composite, chained, constant keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import query, table, view
from rowferry import Work, col, lit, not_empty, template
from rowferry.operators.lookup import lookup_duplicates

LABELS = "order_id bigint, label string, balance double, nation string, region string"
LAST_DUP = """last_dup as (select * from (select *, row_number() over (
    partition by code order by ord desc) as rn from accounts_dup) d where rn = 1)"""


def _target(spark, schema=LABELS):
    return spark.createDataFrame([], schema)


def _orders(spark, sf_dir):
    return (
        Work("label orders")
        .source(table(spark, sf_dir, "orders"), "o", order_by="o_orderkey", row="o_orderkey")
        .into("labels")
    )


def _plan(spark, work, schema=LABELS):
    return work.plan({"labels": _target(spark, schema)})


def flagship(spark, sf_dir):
    """Orders -> account -> nation -> region, a template label, checked target types."""
    return (
        _orders(spark, sf_dir)
        .lookup(view(spark, sf_dir, "accounts"), "account", [("o.o_custkey", "account.id")], order_by="id")
        .lookup(table(spark, sf_dir, "nation"), "nation", [("account.nation_id", "nation.n_nationkey")],
                order_by="n_nationkey")
        .lookup(table(spark, sf_dir, "region"), "region", [("nation.n_regionkey", "region.r_regionkey")],
                order_by="r_regionkey")
        .add({
            "order_id": col("o.o_orderkey"),
            "label": template("{account.email}: {o.o_orderpriority} ({nation.n_name})"),
            "balance": col("account.balance"), "nation": col("nation.n_name"),
            "region": col("region.r_name"),
        })
    )


@query(
    "lookup_inner",
    "select o_orderkey as order_id, email as label, balance from orders join accounts on o_custkey = id",
    ("accounts",),
)
def lookup_inner(spark, sf_dir):
    work = _orders(spark, sf_dir).lookup(
        view(spark, sf_dir, "accounts"), "a", [("o.o_custkey", "a.id")], order_by="id"
    ).add({"order_id": col("o_orderkey"), "label": col("a.email"), "balance": col("a.balance")})
    return _plan(spark, work).inserts()


@query(
    "lookup_text_key",
    """select i.ord, a.id as account, a.balance from incoming_accounts i
       join accounts a on lower(trim(i.email)) = lower(trim(a.email))""",
    ("incoming_accounts", "accounts"),
)
def lookup_text_key(spark, sf_dir):
    """Text keys match without case and padding."""
    work = (
        Work("w").source(view(spark, sf_dir, "incoming_accounts"), "i", order_by="ord", row="ord")
        .lookup(view(spark, sf_dir, "accounts"), "a", [("i.email", "a.email")], order_by="id")
        .into("labels").add({"ord": col("i.ord"), "account": col("a.id"), "balance": col("a.balance")})
    )
    return _plan(spark, work, "ord bigint, account bigint, balance double").inserts()


@query(
    "lookup_rejects",
    """select row_no as row, 'a' as "column", concat('查表 [a] 查無對應：', o_custkey) as reason
       from (select *, row_number() over (order by o_orderkey) + 1 as row_no from orders) o
       where o_custkey not in (select id from accounts)""",
    ("accounts",),
)
def lookup_rejects(spark, sf_dir):
    """Misses with the source row number (a header counts as line 1)."""
    work = (
        Work("w").source(table(spark, sf_dir, "orders"), "o", order_by="o_orderkey", first_row=2)
        .lookup(view(spark, sf_dir, "accounts"), "a", [("o.o_custkey", "a.id")], order_by="id")
        .into("labels").add({"order_id": col("o_orderkey"), "label": col("a.email")})
    )
    return _plan(spark, work).rejects()


@query(
    "lookup_left",
    """select o_orderkey as order_id, email as label, balance
       from orders left join accounts on o_custkey = id""",
    ("accounts",),
)
def lookup_left(spark, sf_dir):
    work = _orders(spark, sf_dir).lookup(
        view(spark, sf_dir, "accounts"), "a", [("o.o_custkey", "a.id")], how="left", order_by="id"
    ).add({"order_id": col("o_orderkey"), "label": col("a.email"), "balance": col("a.balance")})
    return _plan(spark, work).inserts()


@query(
    "lookup_last_wins",
    f"""with {LAST_DUP} select o_orderkey as order_id, d.label
        from orders join customer c on o_custkey = c_custkey
        join last_dup d on d.code = concat(c_mktsegment, '-', c_nationkey)""",
    ("accounts_dup",),
)
def lookup_last_wins(spark, sf_dir):
    """Repeated lookup keys: the last row counts, found through a template key."""
    work = (
        _orders(spark, sf_dir)
        .lookup(table(spark, sf_dir, "customer"), "c", [("o.o_custkey", "c.c_custkey")],
                order_by="c_custkey")
        .lookup(view(spark, sf_dir, "accounts_dup"), "d",
                [(template("{c.c_mktsegment}-{c.c_nationkey}"), "d.code")], order_by="ord")
        .add({"order_id": col("o_orderkey"), "label": col("d.label")})
    )
    return _plan(spark, work).inserts()


@query(
    "lookup_duplicates",
    """select count(distinct code) as keys, cast(count(*) - count(distinct code) as bigint) as duplicates
       from accounts_dup""",
    ("accounts_dup",),
)
def lookup_duplicates_query(spark, sf_dir):
    return lookup_duplicates(view(spark, sf_dir, "accounts_dup"), ["code"])


@query(
    "lookup_composite",
    f"""with {LAST_DUP} select a.id as order_id, d.label from accounts a
        left join last_dup d on nullif(lower(trim(a.nick)), '') = lower(d.segment)
          and a.nation_id = d.nation_id""",
    ("accounts", "accounts_dup"),
)
def lookup_composite(spark, sf_dir):
    """Two key parts; a NULL or blank part never matches."""
    work = (
        Work("w").source(view(spark, sf_dir, "accounts"), "a", order_by="id", row="id")
        .lookup(view(spark, sf_dir, "accounts_dup"), "d",
                [("a.nick", "d.segment"), ("a.nation_id", "d.nation_id")], how="left", order_by="ord")
        .into("labels").add({"order_id": col("a.id"), "label": col("d.label")})
    )
    return _plan(spark, work).inserts()


@query(
    "lookup_chain",
    """select o_orderkey as order_id, concat(email, ': ', o_orderpriority, ' (', n_name, ')') as label,
         balance, n_name as nation, r_name as region
       from orders join accounts on o_custkey = id join nation on nation_id = n_nationkey
       join region on n_regionkey = r_regionkey""",
    ("accounts",),
)
def lookup_chain(spark, sf_dir):
    return _plan(spark, flagship(spark, sf_dir)).inserts()


@query(
    "lookup_chain_rejects",
    """select o_orderkey as row, case when id is null then 'account' else 'nation' end as "column",
         case when id is null then concat('查表 [account] 查無對應：', o_custkey)
              else concat('查表 [nation] 查無對應：', nation_id) end as reason
       from orders left join accounts on o_custkey = id
       left join (select * from nation where n_nationkey % 3 <> 1) n on nation_id = n_nationkey
       where id is null or n_nationkey is null""",
    ("accounts",),
)
def lookup_chain_rejects(spark, sf_dir):
    """Of several misses the first one is reported."""
    work = (
        _orders(spark, sf_dir)
        .lookup(view(spark, sf_dir, "accounts"), "account", [("o.o_custkey", "account.id")], order_by="id")
        .lookup(table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 1"), "nation",
                [("account.nation_id", "nation.n_nationkey")], order_by="n_nationkey")
        .add({"order_id": col("o_orderkey"), "nation": col("nation.n_name")})
    )
    return _plan(spark, work).rejects()


@query(
    "lookup_const_key",
    """select o_orderkey as order_id, c_name as label from orders join customer
       on o_custkey = c_custkey and c_mktsegment = 'BUILDING'""",
)
def lookup_const_key(spark, sf_dir):
    work = _orders(spark, sf_dir).lookup(
        table(spark, sf_dir, "customer"), "c",
        [(lit("building"), "c.c_mktsegment"), ("o.o_custkey", "c.c_custkey")], order_by="c_custkey",
    ).add({"order_id": col("o_orderkey"), "label": col("c.c_name")})
    return _plan(spark, work).inserts()


@query(
    "lookup_const_only",
    """select o_orderkey as order_id, (select max_by(c_name, c_custkey) from customer
         where c_mktsegment = 'BUILDING') as label from orders""",
)
def lookup_const_only(spark, sf_dir):
    """Every source row meets the last lookup row that the constant names."""
    work = _orders(spark, sf_dir).lookup(
        table(spark, sf_dir, "customer"), "c", [(lit("building"), "c.c_mktsegment")], order_by="c_custkey",
    ).add({"order_id": col("o_orderkey"), "label": col("c.c_name")})
    return _plan(spark, work).inserts()


@query(
    "where_after_lookup",
    """select 'good' as outcome, count(*) as n_rows from orders join accounts on o_custkey = id
         where nick is not null and trim(nick) <> ''
       union all select 'reject', count(*) from orders where o_custkey not in (select id from accounts)""",
    ("accounts",),
)
def where_after_lookup(spark, sf_dir):
    """WHERE drops rows in silence, but only after lookup misses are reported."""
    work = (
        _orders(spark, sf_dir)
        .lookup(view(spark, sf_dir, "accounts"), "a", [("o.o_custkey", "a.id")], order_by="id")
        .where(not_empty("a.nick"))
        .add({"order_id": col("o_orderkey"), "label": col("a.nick")})
    )
    plan = _plan(spark, work)
    good = plan.inserts().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("good").alias("outcome"), "n_rows")
    bad = plan.rejects().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("reject").alias("outcome"), "n_rows")
    return good.unionAll(bad)
