"""Targets that are written: versions, stored types, affected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.merges import INSERTED, LAST_OLD, NEW, ON, UPD, V, _work
from queries.registry import query, table, view
from rowferry import VersionedTable, Work, col, run_works
from rowferry.scratch import scratch_path
from rowferry.sources.sinks import append_rows


def _accounts(spark, sf_dir):
    """target_accounts as a versioned table of one appended version."""
    rows = view(spark, sf_dir, "target_accounts")
    store = VersionedTable.create(spark, scratch_path(spark, "accounts"), rows.schema)
    store.append(rows)
    return store


@query(
    "work_written",
    f"""select t.id, t.email, coalesce(l.label, t.label) as label,
          case when l.label is null then t.state else 'UPD' end as state
        from target_accounts t left join {LAST_OLD} l on lower(trim(l.email)) = t.email
        union all {INSERTED}""",
    V,
)
def work_written(spark, sf_dir):
    """An upsert into a versioned table, read back from its folder."""
    store = _accounts(spark, sf_dir)
    work = _work(spark, sf_dir).on(ON).not_matched_add(NEW).matched_update(UPD)
    run_works(spark, [work], {"accounts": store})
    return VersionedTable(store.path).read(spark)


@query(
    "publish_after_add",
    """select 1 as version, count(*) as n_rows, count(*) filter (state = 'NEW') as added from target_accounts
       union all select 2, (select count(*) from target_accounts) + count(*), count(*) from incoming_accounts
       union all select 3, count(*), 0 from target_accounts where id % 2 = 0""",
    V,
)
def publish_after_add(spark, sf_dir):
    """A work adds rows, a snapshot is published over them; every version can still be read."""
    store = _accounts(spark, sf_dir)
    run_works(spark, [_work(spark, sf_dir).add(NEW)], {"accounts": store})
    store.replace(store.read(spark).where("state = 'OLD' and id % 2 = 0"))
    frames = [
        store.read(spark, v).agg(
            F.lit(v).alias("version"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("state") == "NEW").alias("added")
        )
        for v in store.versions(spark)[1:]
    ]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


@query(
    "work_narrow_target",
    """with s as (select o_orderkey as n, o_custkey % 300 as small, o_totalprice as price,
          concat('note', cast(o_custkey as varchar)) as note from orders),
        t as (select *, case when small > 127 then 'small' when price >= 99999.995 then 'price'
          when length(note) > 7 then 'note' end as bad from s)
        select 'row' as outcome, n, cast(small as bigint) as small, price, note, cast(null as varchar) as reason
          from t where bad is null
        union all select 'reject', n, null, null, null, bad || ': 「' || case bad when 'small' then cast(small as varchar)
            when 'price' then regexp_replace(cast(price as varchar), '[.]0$', '') else note end
          || '」超出 ' || case bad when 'small' then 'tinyint' when 'price' then 'decimal(7,2)' else 'varchar(7)' end
          || ' 可儲存的範圍' from t where bad is not null""",
)
def work_narrow_target(spark, sf_dir):
    """Values that the target's types cannot hold are rejected with a reason; the others are written."""
    source = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey n", "o_custkey % 300 small", "o_totalprice price", "concat('note', o_custkey) note"
    )
    schema = spark.createDataFrame([], "n bigint, small tinyint, price decimal(7,2), note string").schema
    schema["note"].metadata["__CHAR_VARCHAR_TYPE_STRING"] = "varchar(7)"
    store = VersionedTable.create(spark, scratch_path(spark, "narrow"), schema)
    work = (
        Work("narrow").source(source, "s", order_by="n", row="n").into("narrow")
        .add({"n": col("s.n"), "small": col("s.small"), "price": col("s.price"), "note": col("s.note")})
    )
    result = run_works(spark, [work], {"narrow": store})
    rows = store.read(spark).select(
        F.lit("row").alias("outcome"), "n", F.col("small").cast("bigint").alias("small"),
        F.col("price").cast("double").alias("price"), "note", F.lit(None).cast("string").alias("reason"),
    )
    rejects = result.rejects.select(
        F.lit("reject"), "row", F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string"),
        F.concat_ws(": ", "column", "reason"),
    )
    return rows.unionAll(rejects)


@query(
    "sink_folder_types",
    """select cast(o_orderkey as integer) as k, o_totalprice as price, cast(null as varchar) as note from orders
       union all select cast(c_custkey as integer), cast(null as double), c_name from customer""",
)
def sink_folder_types(spark, sf_dir):
    """Rows of wider types are appended to a folder in its stored types."""
    path = scratch_path(spark, "typed")
    append_rows(
        table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as int) k", "o_totalprice price", "cast(null as string) note"), path
    )
    append_rows(table(spark, sf_dir, "customer").selectExpr("c_name NOTE", "cast(c_custkey as bigint) K"), path)
    return spark.read.parquet(path)


@query(
    "update_rows_affected",
    """with s as (select c_nationkey as k, count(*) as n from customer group by 1),
         hit as (select count(*) as n from customer where c_nationkey in (select n_nationkey from nation where n_nationkey % 3 = 0)),
         gone as (select count(*) as n from customer where c_nationkey in (select n_nationkey from nation where n_nationkey % 5 = 1))
       select 'set' as work, 0 as inserted, hit.n as updated, 0 as deleted from hit
       union all select 'drop', 0, 0, gone.n from gone""",
)
def update_rows_affected(spark, sf_dir):
    """One change per nation; counted are the customers it hits."""
    nations = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer")
    store = VersionedTable.create(spark, scratch_path(spark, "customers"), customers.schema)
    store.append(customers)

    def work(name, rest):
        source = nations.where(rest)
        return Work(name).source(source, "n", order_by="n_nationkey", row="n_nationkey").into("c", "c").on(
            [("n.n_nationkey", "c.c_nationkey")]
        )

    works = [
        work("set", "n_nationkey % 3 = 0").matched_update({"c_mktsegment": col("n.n_name")}),
        work("drop", "n_nationkey % 5 = 1").matched_delete(),
    ]
    result = run_works(spark, works, {"c": store})
    return spark.createDataFrame(
        [(w.name, w.inserted, w.updated, w.deleted) for w in result.works],
        "work string, inserted int, updated bigint, deleted bigint",
    )
