"""Sources: CSV, tables, queries, types, catalog, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import TABLES, query, table, view
from rowferry.functions.sniff import infer_types, sniff_cells
from rowferry.operators.mapping import Rule, apply_rules, good_rows
from rowferry.scratch import scratch_path
from rowferry.sources.files import block_digests, content_checksum, file_fingerprint, read_csv
from rowferry.sources.sinks import export_csv
from rowferry.sources.tables import (
    describe_columns,
    file_preview,
    limit_rows,
    preview,
    query_fingerprint,
    read_query,
    read_table,
    rows_to_json,
)
from rowferry.types import Kind, from_native_type, normalize_types

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("scan_table", f"select {ORDERS} from orders")
def scan_table(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/orders.parquet")


@query("scan_csv", f"select {ORDERS} from orders")
def scan_csv(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    export_csv(table(spark, sf_dir, "orders"), path)
    kinds = [Kind.INTEGER, Kind.INTEGER, Kind.TEXT, Kind.FLOAT, Kind.DATETIME, Kind.TEXT]
    names = ORDERS.split(", ")
    rules = [Rule(i, n, n, k) for i, (n, k) in enumerate(zip(names, kinds))]
    return good_rows(apply_rules(read_csv(spark, path), rules, None), names)


@query(
    "scan_csv_line_numbers",
    """select 1 + row_number() over (order by c_custkey) as line, c_custkey,
         concat(c_name, chr(10), c_mktsegment) as note from customer""",
)
def scan_csv_line_numbers(spark, sf_dir):
    """Quoted line ends inside fields; lines numbered from 2, in file order."""
    path = scratch_path(spark, "customer-csv")
    noted = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_name", F.lit("\n"), "c_mktsegment").alias("note")
    )
    export_csv(noted.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey"), path)
    lines = read_csv(spark, path, row_no="line", typed=False)
    return lines.select("line", F.col("c_custkey").cast("bigint").alias("c_custkey"), "note")


# Short, wide, one-cell and blank records by turns; the second form has a quoted line end.
_RAGGED = """case pmod(c_custkey, 4) when 0 then concat(c_custkey, ',', {name})
    when 1 then concat(c_custkey, ',', {name}, ',', c_mktsegment, ',extra')
    when 2 then cast(c_custkey as string) else '  ' end"""
_RAGGED_FORMS = (
    ("header", True, None, "c_name"), ("bare", False, None, "c_name"),
    ("utf16", False, "UTF-16LE", "c_name"), ("quoted", False, None, "concat('\"', c_name, '\\n\"')"),
)


@query(
    "scan_csv_ragged",
    """select form, case when m < 3 then c_custkey end as k,
         case when m < 2 then c_name end as name, case when m = 1 then c_mktsegment end as segment,
         case when m = 1 then 'extra' end as more
       from (select *, c_custkey % 4 as m from customer),
         (values ('header'), ('bare'), ('utf16'), ('quoted')) as f(form)""",
)
def scan_csv_ragged(spark, sf_dir):
    """Cells beyond the header or the first record stay, and so do records of blanks."""
    out = None
    for form, header, encoding, name in _RAGGED_FORMS:
        path = scratch_path(spark, f"ragged-{form}")
        lines = table(spark, sf_dir, "customer").select(F.expr(_RAGGED.format(name=name)).alias("k,name"))
        plain = {"header": header, "quote": "", "sep": "\x01", "ignoreLeadingWhiteSpace": False,
                 "ignoreTrailingWhiteSpace": False, "encoding": encoding or "UTF-8"}
        lines.write.text(path) if form == "quoted" else lines.write.options(**plain).csv(path)
        cells = read_csv(spark, path, encoding=encoding, has_header=header)
        texts = [F.trim(F.col(f"`{c}`.text"), F.lit("\n")) for c in cells.columns]
        read = cells.select(F.lit(form).alias("form"), *texts).toDF("form", "k", "name", "segment", "more")
        read = read.withColumn("k", F.col("k").cast("bigint"))
        out = read if out is None else out.unionByName(read)
    return out


@query("scan_csv_encoding", "select c_custkey, concat('客戶', c_name) as name from customer")
def scan_csv_encoding(spark, sf_dir):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = scratch_path(spark, "customer-big5")
    named = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("客戶"), "c_name").alias("name")
    )
    named.write.option("header", True).option("encoding", "Big5").csv(path)
    cells = read_csv(spark, path, encoding="Big5")
    return cells.select(
        F.col("c_custkey.text").cast("bigint").alias("c_custkey"), F.col("name.text").alias("name")
    )


@query(
    "header_names",
    """select name, count(*) as n_rows from customer,
         (values ('c_custkey'), ('欄位2'), ('欄位3'), ('c_mktsegment')) as h(name) group by name""",
)
def header_names(spark, sf_dir):
    """Header cells that read as a number or a boolean do not name their column."""
    path = scratch_path(spark, "headers-csv")
    renamed = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("2024"), F.col("c_nationkey").alias("true"),
        "c_mktsegment",
    )
    export_csv(renamed, path)
    cells = read_csv(spark, path)
    return cells.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("cell"))
                           for c in cells.columns]))
    ).where("cell is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


_SNIFF_SQL = """
select event_id,
  case when trim(raw_int) = '' or raw_int is null then null
       when regexp_full_match(trim(raw_int), '[0-9]+') then 'integer'
       when regexp_full_match(trim(raw_int), '[0-9]+[.][0-9]+') then 'float' else 'text' end as int_kind,
  trim(raw_int) as int_text,
  case raw_bool when 'TRUE' then 'bool' when '0' then 'integer' else 'text' end as bool_kind,
  case raw_bool when 'TRUE' then 'true' else raw_bool end as bool_text,
  case raw_date when '' then null when '2024-02-30' then 'text'
       when '2024-03-01 10:20' then 'datetime' else 'date' end as date_kind,
  case raw_date when '' then null when '2024/1/5' then '2024-01-05'
       when '2024-03-01 10:20' then '2024-03-01 10:20:00' else raw_date end as date_text
from dirty_events"""


@query("sniff_cells", _SNIFF_SQL, ("dirty_events",))
def sniff_dirty(spark, sf_dir):
    cells = sniff_cells(view(spark, sf_dir, "dirty_events"), ["raw_int", "raw_bool", "raw_date"])
    return cells.select(
        "event_id",
        *[F.col(f"raw_{c}.{part}").alias(f"{c}_{part}")
          for c in ("int", "bool", "date") for part in ("kind", "text")],
    )


@query(
    "infer_types",
    """
    with kinds as (
      select 0 as i, 'event_id' as name, 'integer' as kind from events where event_id is not null
      union all select 1, 'ts', 'datetime' from events where ts is not null
      union all select 2, 'value', 'float' from events where value is not null
      union all select 3, 'raw_bool', case when event_id % 10 = 0 then 'text'
        when event_id % 10 < 5 then 'bool' else 'integer' end from events
      union all select 4, 'amount', case when event_id % 2 = 0 then 'integer' else 'float' end from events
      union all select 5, 'moment', case when event_id % 3 = 0 then 'date' else 'datetime' end from events
      union all select 6, 'nothing', null from events),
    sets as (select i, name, list_sort(list(distinct kind) filter (kind is not null)) as s from kinds group by i, name)
    select cast(i as integer) as "index", name,
      case when len(s) = 1 then s[1] when s = ['float', 'integer'] then 'float'
           when s = ['date', 'datetime'] then 'datetime' when len(s) > 1 then 'text' end as inferred_type
    from sets""",
)
def infer_types_query(spark, sf_dir):
    """The vote over every row: at most six kind names per column are kept."""
    events = table(spark, sf_dir, "events")
    raw = events.selectExpr(
        "event_id", "ts", "value",
        "case when event_id % 10 = 0 then 'yes' when event_id % 10 < 5 then 'TRUE' else '0' end raw_bool",
        "case when event_id % 2 = 0 then cast(event_id as string) else concat(event_id, '.25') end amount",
        "case when event_id % 3 = 0 then '2024/01/05' else '2024-01-05T10:20:30' end moment",
        "case when event_id < 0 then 'x' else ' ' end nothing",
    )
    return infer_types(sniff_cells(raw), sample=None)


JOIN_SQL = """select o.o_orderkey, c.c_name, n.n_name, o.o_totalprice
    from {orders} o join {customer} c on o.o_custkey = c.c_custkey
    join {nation} n on c.c_nationkey = n.n_nationkey"""
AGG_SQL = """select l_returnflag, l_linestatus, count(*) as n_lines,
      cast(sum(l_quantity) as bigint) as sum_qty,
      round(sum(l_extendedprice * (1 - l_discount)), 0) as revenue
    from {lineitem} group by l_returnflag, l_linestatus"""
WINDOW_SQL = """select o_custkey, o_orderkey, o_totalprice from (
      select o_custkey, o_orderkey, o_totalprice,
        row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn
      from {orders}) t where rn <= 3"""
SETOP_SQL = """select c_nationkey as k from {customer} union select s_nationkey from {supplier}
    except select n_nationkey from {nation} where n_regionkey = 0"""


def _plain(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


def _query_views(spark, sf_dir, text):
    return {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}


@query("scan_query_join", _plain(JOIN_SQL))
def scan_query_join(spark, sf_dir):
    return read_query(spark, JOIN_SQL, _query_views(spark, sf_dir, JOIN_SQL))


@query("scan_query_agg", _plain(AGG_SQL))
def scan_query_agg(spark, sf_dir):
    return read_query(spark, AGG_SQL, _query_views(spark, sf_dir, AGG_SQL))


@query("scan_query_window", _plain(WINDOW_SQL))
def scan_query_window(spark, sf_dir):
    return read_query(spark, WINDOW_SQL, _query_views(spark, sf_dir, WINDOW_SQL))


@query("scan_query_setop", f"select cast(k as bigint) as k from ({_plain(SETOP_SQL)}) t")
def scan_query_setop(spark, sf_dir):
    return read_query(spark, SETOP_SQL, _query_views(spark, sf_dir, SETOP_SQL))


@query(
    "normalize_types",
    """select l_orderkey, cast(l_linenumber as bigint) as small, cast(l_extendedprice as double) as price,
         make_timestamp(l_orderkey * 1000000) as zoned, l_shipdate as naive,
         cast(null as varchar) as bin,
         concat('[', l_linenumber, ',', l_suppkey, ']') as nested
       from lineitem""",
)
def normalize_types_query(spark, sf_dir):
    odd = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "cast(l_linenumber as smallint) as small",
        "cast(l_extendedprice as decimal(18,2)) as price",
        "timestamp_seconds(l_orderkey) as zoned",
        "l_shipdate as naive",
        "cast(l_returnflag as binary) as bin",
        "array(l_linenumber, l_suppkey) as nested",
    )
    return normalize_types(odd)


# Columns of the given tables that take part in the catalog queries.
_CATALOG = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
                "l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
}
_SPARK_NAME = """case t when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double'
    when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' else t end"""


def _typeof_sql() -> str:
    parts = []
    for t, columns in _CATALOG.items():
        for i, c in enumerate(columns.split(), start=1):
            parts.append(f"select '{t}' as tbl, '{c}' as name, {i} as ordinal, typeof(max({c})) as t from {t}")
    return " union all ".join(parts)


def _described(spark, sf_dir):
    frames = [
        describe_columns(spark, table(spark, sf_dir, t)).select(F.lit(t).alias("tbl"), "*")
        for t in _CATALOG
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(
    "describe_columns",
    f"""select tbl, name, {_SPARK_NAME} as native_type, true as nullable,
          cast(ordinal as integer) as ordinal from ({_typeof_sql()}) x""",
)
def describe_columns_query(spark, sf_dir):
    return _described(spark, sf_dir)


@query(
    "map_native_types",
    f"""select tbl, name, case t when 'BIGINT' then 'integer' when 'INTEGER' then 'integer'
          when 'DOUBLE' then 'float' when 'VARCHAR' then 'text' when 'TIMESTAMP' then 'datetime' end as kind
        from ({_typeof_sql()}) x""",
)
def map_native_types(spark, sf_dir):
    return _described(spark, sf_dir).select(
        "tbl", "name", from_native_type(F.col("native_type")).alias("kind")
    )


_SHOWN = "regexp_replace(cast(value as varchar), '[.]0$', '')"


@query(
    "preview",
    f"""select cast(event_id as varchar) as event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts,
          cast(user_id as varchar) as user_id, event_type, {_SHOWN} as value, props
        from events order by events.event_id limit 100""",
)
def preview_query(spark, sf_dir):
    """The preview of a source is its first 100 rows: the limit is the feature."""
    return preview(table(spark, sf_dir, "events"), order_by=["event_id"])


@query("limit_rows", f"select {ORDERS} from orders order by o_totalprice desc, o_orderkey limit 500")
def limit_rows_query(spark, sf_dir):
    """A row cap on a query, with an order so that the result is defined."""
    orders = table(spark, sf_dir, "orders")
    return limit_rows(orders, 500, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def _checksum_sql(name: str) -> str:
    """``content_checksum`` in SQL: the first 15 hex digits of each row's MD5, summed up."""
    cells = []
    for c in _CATALOG[name].split():
        text = f"regexp_replace(cast({c} as varchar), '[.]0$', '')" if c in _DOUBLES else f"cast({c} as varchar)"
        cells.append(f"coalesce(concat('=', {text}), '')")
    number = f"('0x' || substr(md5(concat({', chr(31), '.join(cells)})), 1, 15))::bigint"
    return f"""select count(*) as n_rows,
        cast(coalesce(sum(cast({number} as hugeint)), 0) as varchar) as checksum from {name}"""


_DOUBLES = "c_acctbal o_totalprice l_quantity l_extendedprice l_discount l_tax".split()
_WATCHED = {name: f"select * from {name}" for name in ("customer", "orders", "lineitem")}


@query("source_fingerprint")
def source_fingerprint(spark, sf_dir):
    """SHA-256 of every given file; SQL has no view of the files' bytes."""
    files = file_fingerprint(spark, f"{sf_dir}/*.parquet")
    return files.select(F.substring_index("path", "/", -1).alias("file"), "sha256")


@query("content_checksum", _checksum_sql("lineitem"))
def content_checksum_query(spark, sf_dir):
    return content_checksum(table(spark, sf_dir, "lineitem"))


@query("source_fingerprint_query", " union all ".join(
    f"""select '{name}' as source, sha256(concat('sf', chr(10), '{text}')) as fingerprint,
          n_rows, checksum from ({_checksum_sql(name)})""" for name, text in _WATCHED.items()
))
def source_fingerprint_query(spark, sf_dir):
    """A query source's fingerprint, and the digest of the rows it stands for."""
    out = None
    for name, text in _WATCHED.items():
        rows = read_query(spark, text.replace(name, "{" + name + "}"), {name: table(spark, sf_dir, name)})
        part = content_checksum(rows).select(
            F.lit(name).alias("source"), F.lit(query_fingerprint("sf", text)).alias("fingerprint"), "*"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "rows_to_json",
    """select event_id, cast(to_json(struct_pack(event_id := event_id,
         ts := strftime(ts, '%Y-%m-%d %H:%M:%S'), user_id := user_id, event_type := event_type,
         value := value, props := props)) as varchar) as json from events""",
)
def rows_to_json_query(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    keyed = rows_to_json(events)
    return keyed.select(F.get_json_object("json", "$.event_id").cast("bigint").alias("event_id"), "json")


@query(
    "scan_csv_quoted",
    """select cast(row_number() over (order by c_custkey) + 1 as bigint) as line, cast(c_custkey as varchar) as k,
         case when c_custkey % 3 = 0 then concat(c_name, chr(10), chr(10), '"', c_mktsegment, '", x')
           when c_custkey % 3 = 1 then '   ' else c_name end as note from customer""",
)
def scan_csv_quoted(spark, sf_dir):
    """Quoted line ends, quotes, commas and blanks in a file that is read by several tasks, with record numbers."""
    path = scratch_path(spark, "quoted")
    note = F.when(F.col("c_custkey") % 3 == 0, F.expr("concat(c_name, '\n\n', '\"', c_mktsegment, '\", x')"))
    note = note.when(F.col("c_custkey") % 3 == 1, F.lit("   ")).otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), note.alias("note"))
    quoted = rows.select(F.concat(F.col("k").cast("string"), F.lit(',"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"')).alias("value"), "k")
    # One file for each range of keys, so that the files' order is the keys' order.
    quoted.repartitionByRange(3, "k").sortWithinPartitions("k").select("value").write.option("lineSep", "\n").text(path)
    return read_csv(spark, path, has_header=False, typed=False, row_no="line").toDF("line", "k", "note").select(
        (F.col("line") + 1).alias("line"), "k", "note"
    )



@query(
    "infer_types_first",
    """select cast(i as integer) as "index", name, kind as inferred_type, encoding, n_rows from (values
         (0, 'event_id', 'integer'), (1, 'late', 'integer'), (2, 'moment', 'datetime'), (3, 'kind', 'text')) v(i, name, kind),
         (select 'UTF-8' as encoding, count(*) as n_rows from events)""",
)
def infer_types_first(spark, sf_dir):
    """Types by the first 100 records of a folder of files: in all rows, `late` would be text."""
    path = scratch_path(spark, "mixed")
    events = table(spark, sf_dir, "events")
    first = events.orderBy("event_id").limit(100).agg(F.max("event_id").alias("edge"))
    rows = events.withColumn("edge", first.scalar()).selectExpr(
        "event_id", "case when event_id <= edge then cast(event_id as string) else 'text' end as late",
        "case when event_id % 2 = 0 then '2024-01-05' else '2024-01-05 10:20' end as moment", "event_type as kind")
    export_csv(rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), path)
    found = file_preview(spark, path)
    return found.columns.withColumns({"encoding": F.lit(found.encoding), "n_rows": F.lit(found.total_rows).cast("bigint")})


@query(
    "block_digests",
    """with l as (select c_custkey % 4 as r, concat(cast(c_custkey as varchar), ',', c_name) as v,
          row_number() over (partition by c_custkey % 4 order by c_custkey) - 1 as n from customer),
        f as (select r, sum(strlen(v)) + count(*) as size, count(*) as total from l group by r),
        h as (select l.r, n, case when n = total - 1 then sha256(concat(sha256(v), ' ', cast(size as varchar)))
            else sha256(v) end as h from l join f on l.r = f.r)
        select cast(r as integer) as r, n // 100 as part, count(*) as n_lines, sha256(string_agg(h, '' order by n)) as digest
        from h group by r, n // 100""",
)
def block_digests_query(spark, sf_dir):
    """Digests of every hundred lines of four files."""
    path = scratch_path(spark, "digests")
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey % 4 r", "c_custkey k", "concat(c_custkey, ',', c_name) value")
    dealt = rows.repartition("r").sortWithinPartitions("r", "k").select("r", "value")
    dealt.write.option("lineSep", "\n").partitionBy("r").text(path)
    found = block_digests(spark, f"{path}/*", 100)
    return found.select(F.regexp_extract("path", "/r=([0-9]+)/", 1).cast("int").alias("r"), "part", "n_lines", "digest")
