"""Projection, templates, conversion with rejects, keys, generators."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from queries.registry import query, table, view
from rowferry import Gen, Kind, MappingJob, Rule, Work, auto_rules, lit, template
from rowferry.functions.convert import convert
from rowferry.functions.exprs import Scope, col
from rowferry.functions.generators import JobClock
from rowferry.functions.text import display, key
from rowferry.operators.mapping import apply_rules, auto_match, good_rows, reject_rows
from rowferry.types import values_of

CLOCK = JobClock(datetime(2026, 6, 12, 10, 20, 30, 456000, timezone(timedelta(hours=8))))


def assign(df, assignments, clock=CLOCK):
    """Project named operands over one frame."""
    own = values_of(df)
    scope = Scope("s", {"s": {n.lower(): v for n, v in own.items()}}, list(own.values()), clock)
    return df.select(*[e.bind(scope).column.alias(n) for n, e in assignments.items()])


def _empty(spark, schema):
    return spark.createDataFrame([], schema)


@query(
    "project_assign",
    """select o_orderkey as order_id, concat('', o_custkey) as customer, 'import' as origin,
         cast(o_orderdate as date) as day, cast(null as double) as discount from orders""",
)
def project_assign(spark, sf_dir):
    """ADD: assignments in order, converted to the target's types."""
    target = _empty(
        spark, "order_id bigint, customer string, origin string, day date, discount double"
    )
    work = (
        Work("orders")
        .source(table(spark, sf_dir, "orders"), "o", order_by="o_orderkey", row="o_orderkey")
        .into("t")
        .add({
            "order_id": col("o.o_orderkey"), "customer": col("O.[O_CUSTKEY]"), "origin": "import",
            "day": col("o_orderdate"), "discount": lit(None),
        })
    )
    return work.plan({"t": target}).inserts()


@query(
    "project_constants",
    """select p_partkey, 'N/A' as t, cast(42 as bigint) as i, 1.5 :: double as f, true as b,
         cast(null as varchar) as n from part""",
)
def project_constants(spark, sf_dir):
    return assign(
        table(spark, sf_dir, "part"),
        {"p_partkey": col("p_partkey"), "t": lit("N/A"), "i": lit(42), "f": lit(1.5),
         "b": lit(True), "n": lit(None)},
    )


@query(
    "template_concat",
    """select l_orderkey, concat('{', l_returnflag, '/', l_linestatus, '} #', l_linenumber, ' x',
         regexp_replace(cast(l_quantity as varchar), '[.]0$', ''), ' @ ',
         regexp_replace(cast(l_extendedprice as varchar), '[.]0$', ''), ' ',
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), ' v', 7) as label from lineitem""",
)
def template_concat(spark, sf_dir):
    label = template(
        "{{{l_returnflag}/{l_linestatus}}} #{l_linenumber} x{l_quantity} @ {l_extendedprice} "
        "{l_shipdate} v{7}"
    )
    lines = table(spark, sf_dir, "lineitem")
    return assign(lines, {"l_orderkey": col("l_orderkey"), "label": label})


@query(
    "template_nulls",
    "select id, concat('[', coalesce(nick, ''), ']@', nation_id) as tag from accounts",
    ("accounts",),
)
def template_nulls(spark, sf_dir):
    return assign(
        view(spark, sf_dir, "accounts"), {"id": col("id"), "tag": template("[{nick}]@{nation_id}")}
    )


@query(
    "map_columns",
    """select cast(event_id as varchar) as id_text, ts as at, cast(ts as date) as day,
         cast(user_id as double) as user_float, event_type as kind, cast(null as bigint) as extra
       from events""",
)
def map_columns(spark, sf_dir):
    """Rules count by position; a position the source lacks gives NULL."""
    rules = [
        Rule(0, "event_id", "id_text", Kind.TEXT), Rule(1, "ts", "at", Kind.DATETIME),
        Rule(1, "ts", "day", Kind.DATE), Rule(2, "user_id", "user_float", Kind.FLOAT),
        Rule(3, "event_type", "kind", Kind.TEXT), Rule(99, "none", "extra", Kind.INTEGER),
    ]
    tagged = apply_rules(table(spark, sf_dir, "events"), rules, None)
    return good_rows(tagged, [r.target_column for r in rules])


@query(
    "null_policy",
    """select row_no as row, 'raw_int' as "column", '欄位為空，但 NULL 政策為不允許' as reason
       from (select raw_int, row_number() over (order by event_id) as row_no from dirty_events) t
       where raw_int is null""",
    ("dirty_events",),
)
def null_policy(spark, sf_dir):
    job = MappingJob(
        view(spark, sf_dir, "dirty_events"),
        [Rule(3, "raw_int", "n", Kind.TEXT, null_allowed=False)],
        order_by=["event_id"],
    )
    return reject_rows(job.tagged())


@query(
    "auto_match",
    """select cast(id as varchar) as "ID_TEXT", email as "EMAIL", cast(nation_id as double) as "Nation_Id"
       from (select id, email, nation_id from accounts) t""",
    ("accounts",),
)
def auto_match_query(spark, sf_dir):
    """Columns that both sides name, case ignored, converted to the target's types."""
    source = view(spark, sf_dir, "accounts").withColumnRenamed("id", "id_text")
    target = _empty(spark, "ID_TEXT string, Nation_Id double, EMAIL string, other bigint")
    rules = auto_rules(source, target)
    assert list(auto_match(source, target.columns)) == [r.target_column for r in rules]
    return good_rows(apply_rules(source, rules, None), [r.target_column for r in rules])


# --- conversion: value and reason per target type --------------------------


def value_and_reason(df, id_column, column, target):
    value, reason = convert(values_of(df)[column], target)
    return df.select(id_column, value.alias("value"), reason.alias("reason"))


_INT_OK = "regexp_full_match(trim(raw_int), '[0-9]+')"
_INT_WHY = f"case when raw_int is not null and not {_INT_OK} then concat('無法將「', raw_int, '」解析為整數') end"


@query(
    "convert_integer",
    f"select event_id, case when {_INT_OK} then cast(trim(raw_int) as bigint) end as value, "
    f"{_INT_WHY} as reason from dirty_events",
    ("dirty_events",),
)
def convert_integer(spark, sf_dir):
    return value_and_reason(view(spark, sf_dir, "dirty_events"), "event_id", "raw_int", Kind.INTEGER)


@query(
    "convert_integer_from_float",
    """select o_orderkey, case when o_totalprice = floor(o_totalprice) then cast(o_totalprice as bigint) end as value,
         case when o_totalprice <> floor(o_totalprice)
           then concat('無法將 ', cast(o_totalprice as varchar), ' 轉為整數（非整數或溢位）') end as reason
       from orders""",
)
def convert_integer_from_float(spark, sf_dir):
    return value_and_reason(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", Kind.INTEGER)


@query(
    "convert_float",
    """select event_id,
         case when regexp_full_match(trim(raw_int), '[0-9]+([.][0-9]+)?') then cast(trim(raw_int) as double) end as value,
         case when raw_int = 'abc' then '無法將「abc」解析為浮點數' end as reason from dirty_events""",
    ("dirty_events",),
)
def convert_float(spark, sf_dir):
    return value_and_reason(view(spark, sf_dir, "dirty_events"), "event_id", "raw_int", Kind.FLOAT)


@query(
    "convert_text",
    """select l_orderkey, l_linenumber, cast(l_partkey as varchar) as int_text,
         regexp_replace(cast(l_quantity as varchar), '[.]0$', '') as qty_text,
         regexp_replace(cast(l_extendedprice as varchar), '[.]0$', '') as price_text,
         regexp_replace(cast(l_discount as varchar), '[.]0$', '') as discount_text,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as ship_text,
         case when l_tax > 0.04 then 'true' else 'false' end as flag_text,
         strftime(l_shipdate, '%Y-%m-%d') as day_text from lineitem""",
)
def convert_text(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "*", "l_tax > 0.04 as flag", "cast(l_shipdate as date) as day"
    )
    v = values_of(lines)
    shown = {"int_text": "l_partkey", "qty_text": "l_quantity", "price_text": "l_extendedprice",
             "discount_text": "l_discount", "ship_text": "l_shipdate", "flag_text": "flag",
             "day_text": "day"}
    return lines.select("l_orderkey", "l_linenumber",
                        *[convert(v[c], Kind.TEXT)[0].alias(n) for n, c in shown.items()])


@query(
    "convert_bool",
    """select event_id, case raw_bool when 'TRUE' then true when '0' then false end as value,
         case raw_bool when 'yes' then '無法將「yes」解析為布林' end as reason from dirty_events""",
    ("dirty_events",),
)
def convert_bool(spark, sf_dir):
    return value_and_reason(view(spark, sf_dir, "dirty_events"), "event_id", "raw_bool", Kind.BOOL)


@query(
    "convert_bool_from_integer",
    """select l_orderkey, case l_linenumber when 0 then false when 1 then true end as value,
         case when l_linenumber not in (0, 1)
           then concat('無法將 ', l_linenumber, ' 轉為布林（僅接受 0/1）') end as reason from lineitem""",
)
def convert_bool_from_integer(spark, sf_dir):
    return value_and_reason(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", Kind.BOOL)


@query(
    "convert_datetime",
    """select event_id, case raw_date when '2024/1/5' then timestamp '2024-01-05 00:00:00'
           when '2024-03-01 10:20' then timestamp '2024-03-01 10:20:00'
           when '2024-01-15' then timestamp '2024-01-15 00:00:00' end as value,
         case when raw_date in ('', '2024-02-30') then concat('無法將「', raw_date, '」解析為日期時間') end as reason
       from dirty_events""",
    ("dirty_events",),
)
def convert_datetime(spark, sf_dir):
    return value_and_reason(view(spark, sf_dir, "dirty_events"), "event_id", "raw_date", Kind.DATETIME)


@query(
    "convert_date",
    """select event_id, case raw_date when '2024/1/5' then date '2024-01-05'
           when '2024-01-15' then date '2024-01-15' end as value,
         case when raw_date not in ('2024/1/5', '2024-01-15')
           then concat('無法將「', raw_date, '」解析為日期') end as reason from dirty_events""",
    ("dirty_events",),
)
def convert_date(spark, sf_dir):
    return value_and_reason(view(spark, sf_dir, "dirty_events"), "event_id", "raw_date", Kind.DATE)


@query(
    "convert_unsupported",
    """select event_id, cast(null as date) as value, '不支援 Some(Integer) → Date 的轉換' as reason
       from events""",
)
def convert_unsupported(spark, sf_dir):
    return value_and_reason(table(spark, sf_dir, "events"), "event_id", "event_id", Kind.DATE)


DIRTY_RULES = [
    Rule(0, "event_id", "id", Kind.INTEGER, null_allowed=False),
    Rule(3, "raw_int", "n", Kind.INTEGER),
    Rule(4, "raw_bool", "flag", Kind.BOOL),
    Rule(5, "raw_date", "at", Kind.DATETIME),
]
DIRTY_CTE = f"""with t as (
  select event_id, raw_int, raw_bool, raw_date, row_number() over (order by event_id) as row_no,
    case when raw_int is not null and not {_INT_OK} then 'raw_int'
         when raw_bool = 'yes' then 'raw_bool'
         when raw_date in ('', '2024-02-30') then 'raw_date' end as bad
  from dirty_events)"""


def dirty_job(spark, sf_dir, **options):
    return MappingJob(
        view(spark, sf_dir, "dirty_events"), DIRTY_RULES, order_by=["event_id"], **options
    )


@query(
    "convert_rows",
    f"""{DIRTY_CTE} select event_id as id, cast(trim(raw_int) as bigint) as n, raw_bool = 'TRUE' as flag,
          case raw_date when '2024/1/5' then timestamp '2024-01-05 00:00:00'
            when '2024-03-01 10:20' then timestamp '2024-03-01 10:20:00'
            else timestamp '2024-01-15 00:00:00' end as at from t where bad is null""",
    ("dirty_events",),
)
def convert_rows(spark, sf_dir):
    tagged = apply_rules(view(spark, sf_dir, "dirty_events"), DIRTY_RULES, None)
    return good_rows(tagged, ["id", "n", "flag", "at"])


REJECTS_SQL = f"""{DIRTY_CTE} select row_no as row, bad as "column",
      case bad when 'raw_int' then concat('無法將「', raw_int, '」解析為整數')
        when 'raw_bool' then concat('無法將「', raw_bool, '」解析為布林')
        else concat('無法將「', raw_date, '」解析為日期時間') end as reason
    from t where bad is not null"""


@query("convert_rejects", REJECTS_SQL, ("dirty_events",))
def convert_rejects(spark, sf_dir):
    return reject_rows(dirty_job(spark, sf_dir).tagged())


@query(
    "normalize_key",
    """select id, nullif(lower(trim(email)), '') as email_key, nullif(lower(trim(nick)), '') as nick_key,
         cast(nation_id as varchar) as nation_key,
         regexp_replace(cast(balance as varchar), '[.]0$', '') as balance_key from accounts""",
    ("accounts",),
)
def normalize_key(spark, sf_dir):
    accounts = view(spark, sf_dir, "accounts")
    v = values_of(accounts)
    return accounts.select(
        "id", *[key(v[c]).alias(n) for n, c in (
            ("email_key", "email"), ("nick_key", "nick"), ("nation_key", "nation_id"),
            ("balance_key", "balance"))]
    )


# --- generators -------------------------------------------------------------

_ROW_SQL = """concat_ws(chr(31), l_orderkey, l_partkey, l_suppkey, l_linenumber,
    regexp_replace(cast(l_quantity as varchar), '[.]0$', ''),
    regexp_replace(cast(l_extendedprice as varchar), '[.]0$', ''),
    regexp_replace(cast(l_discount as varchar), '[.]0$', ''),
    regexp_replace(cast(l_tax as varchar), '[.]0$', ''),
    l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))"""


def _hashed(spark, sf_dir, label):
    lines = table(spark, sf_dir, "lineitem")
    return assign(lines, {"l_orderkey": col("l_orderkey"), "l_linenumber": col("l_linenumber"),
                          "hash": Gen(label)})


@query("gen_sha256", f"select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, "
                     f"sha256({_ROW_SQL}) as hash from lineitem")
def gen_sha256(spark, sf_dir):
    return _hashed(spark, sf_dir, "SHA256")


@query("gen_md5", f"select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, "
                  f"md5({_ROW_SQL}) as hash from lineitem")
def gen_md5(spark, sf_dir):
    return _hashed(spark, sf_dir, "MD5")


@query(
    "gen_sha512",
    f"""select count(*) as n_rows, count(distinct {_ROW_SQL}) as n_hashes, count(*) as n_hex
        from lineitem""",
)
def gen_sha512(spark, sf_dir):
    """DuckDB has no SHA-512: as many hashes as distinct rows, all 128 hex digits."""
    h = _hashed(spark, sf_dir, "SHA512")
    return h.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("hash").alias("n_hashes"),
        F.count_if(F.col("hash").rlike("^[0-9a-f]{128}$")).alias("n_hex"),
    )


@query("gen_guid", "select count(*) as n_rows, count(*) as n_ids, count(*) as n_v4 from orders")
def gen_guid(spark, sf_dir):
    ids = assign(table(spark, sf_dir, "orders"), {"id": Gen("GUID")})
    v4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return ids.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
        F.count_if(F.col("id").rlike(v4)).alias("n_v4"),
    )


@query(
    "gen_ulid",
    "select count(*) as n_rows, count(*) as n_ids, count(*) as n_crockford, 1 as n_heads from orders",
)
def gen_ulid(spark, sf_dir):
    ids = assign(table(spark, sf_dir, "orders"), {"id": Gen("ULID")})
    return ids.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
        F.count_if(F.col("id").rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")).alias("n_crockford"),
        F.count_distinct(F.substring("id", 1, 10)).cast("int").alias("n_heads"),
    )


@query(
    "gen_dates",
    """select event_id, date '2026-06-12' as d, '2026-06-12' as d_text,
         timestamp '2026-06-12 10:20:30.456' as dt, '2026-06-12 10:20:30' as dt_text,
         '2026-06-12T10:20:30.456+08:00' as dto, '2026-06-12T10:20:30.456+08:00' as dto_text
       from events""",
)
def gen_dates(spark, sf_dir):
    """Times are those of the job start, so every row has the same."""
    return assign(
        table(spark, sf_dir, "events"),
        {"event_id": col("event_id"), "d": Gen("Date"), "d_text": Gen("Date(Text)"),
         "dt": Gen("DateTime"), "dt_text": Gen("DateTime(Text)"), "dto": Gen("DateTimeOffset"),
         "dto_text": Gen("DateTimeOffset(Text)")},
    )


__all__ = ["assign", "value_and_reason", "dirty_job", "display"]
