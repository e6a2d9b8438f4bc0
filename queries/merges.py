"""Merging into a target: match probes, inserts, updates, deletes, several works."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import query, table, view
from rowferry import Work, col, eq, lit, run_works
from rowferry.functions.text import key
from rowferry.operators.merge import matched_rows, unmatched_rows
from rowferry.types import values_of

V = ("incoming_accounts", "target_accounts")
KEY = "lower(trim({0}.email))"
FIRST_NEW = """(select * from (select i.*, row_number() over (partition by lower(trim(i.email)) order by ord) as rn
      from incoming_accounts i where i.email is not null and lower(trim(i.email)) not in (select email from target_accounts)) f
      where rn = 1)"""
LAST_OLD = """(select * from (select i.*, row_number() over (partition by lower(trim(i.email)) order by ord desc) as rn
      from incoming_accounts i where i.email is not null) l where rn = 1)"""
INSERTED = f"""select id, email, label, 'NEW' as state from {FIRST_NEW} n
    union all select id, email, label, 'NEW' from incoming_accounts where email is null"""
UPDATED = f"""select t.id, t.email, coalesce(l.label, t.label) as label,
      case when l.label is null then t.state else 'UPD' end as state
    from target_accounts t left join {LAST_OLD} l on lower(trim(l.email)) = t.email"""


def _work(spark, sf_dir, name="merge"):
    return (
        Work(name).source(view(spark, sf_dir, "incoming_accounts"), "i", order_by="ord", row="ord")
        .into("accounts", "t")
    )


def _target(spark, sf_dir):
    return {"accounts": view(spark, sf_dir, "target_accounts")}


NEW = {"id": col("i.id"), "email": col("i.email"), "label": col("i.label"), "state": "NEW"}
UPD = {"label": col("i.label"), "state": "UPD"}
ON = [("i.email", "t.email")]


def _probe_sides(spark, sf_dir):
    incoming, target = view(spark, sf_dir, "incoming_accounts"), view(spark, sf_dir, "target_accounts")
    return (incoming, [key(values_of(incoming)["email"])],
            target, [key(values_of(target)["email"])])


@query(
    "merge_matched_keys",
    "select ord, id, email from incoming_accounts i where lower(trim(email)) in (select email from target_accounts)",
    V,
)
def merge_matched_keys(spark, sf_dir):
    return matched_rows(*_probe_sides(spark, sf_dir)).select("ord", "id", "email")


@query(
    "merge_unmatched_keys",
    """select ord, id, email from incoming_accounts i
       where email is null or lower(trim(email)) not in (select email from target_accounts)""",
    V,
)
def merge_unmatched_keys(spark, sf_dir):
    return unmatched_rows(*_probe_sides(spark, sf_dir), F.xxhash64("ord")).select("ord", "id", "email")


@query(
    "work_add",
    """select id, email, label, state from target_accounts
       union all select id, email, label, 'NEW' from incoming_accounts""",
    V,
)
def work_add(spark, sf_dir):
    """ADD without a merge key appends every row."""
    return _work(spark, sf_dir).add(NEW).plan(_target(spark, sf_dir)).apply()


@query("merge_insert", f"select * from target_accounts union all {INSERTED}", V)
def merge_insert(spark, sf_dir):
    return _work(spark, sf_dir).on(ON).not_matched_add(NEW).plan(_target(spark, sf_dir)).apply()


@query("merge_first_wins", f"select id, email, label, 'NEW' as state from {FIRST_NEW} n", V)
def merge_first_wins(spark, sf_dir):
    plan = _work(spark, sf_dir).on(ON).not_matched_add(NEW).plan(_target(spark, sf_dir))
    return plan.inserts().where("email is not null")


@query(
    "merge_null_keys",
    "select id, email, label, 'NEW' as state from incoming_accounts where email is null",
    V,
)
def merge_null_keys(spark, sf_dir):
    """Rows without a key are neither matched nor taken for duplicates."""
    plan = _work(spark, sf_dir).on(ON).not_matched_add(NEW).plan(_target(spark, sf_dir))
    return plan.inserts().where("email is null")


@query("merge_update", UPDATED, V)
def merge_update(spark, sf_dir):
    return _work(spark, sf_dir).on(ON).matched_update(UPD).plan(_target(spark, sf_dir)).apply()


@query(
    "merge_update_last_wins",
    f"""select lower(trim(l.email)) as email_key, l.label from {LAST_OLD} l
        join target_accounts t on lower(trim(l.email)) = t.email""",
    V,
)
def merge_update_last_wins(spark, sf_dir):
    plan = _work(spark, sf_dir).on(ON).matched_update(UPD).plan(_target(spark, sf_dir))
    return plan.changes().select(
        F.col("__ferry_k0").alias("email_key"), F.col("__ferry_v.label").alias("label")
    )


@query(
    "merge_delete",
    """select * from target_accounts where email not in (
         select lower(trim(email)) from incoming_accounts where email is not null)""",
    V,
)
def merge_delete(spark, sf_dir):
    return _work(spark, sf_dir).on(ON).matched_delete().plan(_target(spark, sf_dir)).apply()


@query(
    "merge_delete_some",
    """select * from target_accounts where email not in (
         select lower(trim(email)) from incoming_accounts where email is not null and label ilike 'dup-%')""",
    V,
)
def merge_delete_some(spark, sf_dir):
    """WHERE chooses the rows whose keys are deleted."""
    from rowferry import like

    work = _work(spark, sf_dir).where(like("i.label", "dup-%")).on(ON).matched_delete()
    return work.plan(_target(spark, sf_dir)).apply()


@query("merge_skip", f"select * from target_accounts union all {INSERTED}", V)
def merge_skip(spark, sf_dir):
    work = _work(spark, sf_dir).on(ON).matched_skip().not_matched_add(NEW)
    return work.plan(_target(spark, sf_dir)).apply()


@query("merge_upsert", f"{UPDATED} union all {INSERTED}", V)
def merge_upsert(spark, sf_dir):
    work = _work(spark, sf_dir).on(ON).matched_update(UPD).not_matched_add(NEW)
    return work.plan(_target(spark, sf_dir)).apply()


@query(
    "merge_exact_key",
    """select t.id, t.email, coalesce(l.label, t.label) as label,
         case when l.label is null then t.state else 'UPD' end as state
       from target_accounts t left join (select * from (select c.*, row_number() over (
           partition by email order by ord desc) as rn from incoming_lower c) x where rn = 1) l
         on l.email = t.email""".replace(
        "incoming_lower",
        "(select ord, case when id % 2 = 0 then lower(email) else email end as email, label from incoming_accounts)",
    ),
    V,
)
def merge_exact_key(spark, sf_dir):
    """Match on keys, but change only rows that store exactly the converted key."""
    half = view(spark, sf_dir, "incoming_accounts").withColumn(
        "email", F.expr("case when id % 2 = 0 then lower(email) else email end")
    )
    work = (
        Work("exact").source(half, "i", order_by="ord", row="ord").into("accounts", "t")
        .on(ON, match="exact").matched_update(UPD)
    )
    return work.plan(_target(spark, sf_dir)).apply()


@query(
    "merge_const_key",
    f"""select t.id, t.email, coalesce(l.label, t.label) as label, t.state
        from target_accounts t left join {LAST_OLD} l
          on lower(trim(l.email)) = t.email and t.label = 'BUILDING'""",
    V,
)
def merge_const_key(spark, sf_dir):
    """A constant part of the merge key restricts which target rows count."""
    work = (
        _work(spark, sf_dir).on(eq("t.label", lit("building")) & eq("t.email", col("i.email")))
        .matched_update({"label": col("i.label")})
    )
    return work.plan(_target(spark, sf_dir)).apply()


@query(
    "multi_work",
    f"""with added as ({UPDATED} union all {INSERTED})
        select id, email, case when id % 5 = 0 and email is not null then 'BLOCKED' else label end as label, state
        from added where id % 7 <> 0 or email is null""",
    V,
)
def multi_work(spark, sf_dir):
    """Upsert, then delete and update what the first work wrote."""
    customers = table(spark, sf_dir, "customer")
    works = [
        _work(spark, sf_dir, "upsert").on(ON).matched_update(UPD).not_matched_add(NEW),
        Work("drop").source(customers.where("c_custkey % 7 = 0"), "c", order_by="c_custkey", row="c_custkey")
        .into("accounts", "t").on([("c.c_name", "t.email")]).matched_delete(),
        Work("block").source(customers.where("c_custkey % 5 = 0"), "c", order_by="c_custkey", row="c_custkey")
        .lookup("accounts", "a", [("c.c_name", "a.email")], how="left", order_by="id")
        .into("accounts", "t").on([("a.email", "t.email")]).matched_update({"label": "BLOCKED"}),
    ]
    return run_works(spark, works, _target(spark, sf_dir)).tables["accounts"]
