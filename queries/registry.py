"""Query registry and the derived views that supply what the given tables lack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# One text for both engines: names in braces are the given tables.
VIEWS = {
    # Bad integers, fractions, padding, NULLs, odd booleans, impossible dates.
    "dirty_events": """
        select event_id, user_id, event_type,
          case when event_id % 11 = 0 then 'abc' when event_id % 13 = 0 then null
               when event_id % 17 = 0 then '1.5'
               when event_id % 19 = 0 then concat('  ', cast(event_id as string), ' ')
               else cast(event_id as string) end as raw_int,
          case when event_id % 10 = 0 then 'yes' when event_id % 10 < 5 then 'TRUE'
               else '0' end as raw_bool,
          case when event_id % 9 = 0 then '2024-02-30' when event_id % 9 = 1 then '2024/1/5'
               when event_id % 9 = 2 then '2024-03-01 10:20' when event_id % 9 = 3 then ''
               else '2024-01-15' end as raw_date
        from {events}""",
    # Lookup side: case and padding noise, blank and NULL nick, holes.
    "accounts": """
        select c_custkey as id,
          case when c_custkey % 5 = 0 then upper(c_name)
               when c_custkey % 5 = 1 then concat(' ', c_name, ' ') else c_name end as email,
          case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then '   '
               else c_mktsegment end as nick,
          cast(c_nationkey as bigint) as nation_id, c_acctbal as balance
        from {customer} where c_custkey % 7 <> 0""",
    # Lookup side with repeated keys; ord tells which comes last.
    "accounts_dup": """
        select c_custkey as ord, concat(c_mktsegment, '-', cast(c_nationkey as string)) as code,
          c_custkey as id, c_name as label, c_mktsegment as segment,
          cast(c_nationkey as bigint) as nation_id
        from {customer}""",
    # Merge target.
    "target_accounts": """
        select c_custkey as id, lower(c_name) as email, c_mktsegment as label, 'OLD' as state
        from {customer} where c_custkey % 3 = 0""",
    # Merge source: NULL keys and case-only duplicates; ord is unique.
    "incoming_accounts": """
        select c_custkey * 2 as ord, c_custkey as id,
          case when c_custkey % 50 = 1 then null else c_name end as email,
          concat('new-', c_mktsegment) as label from {customer}
        union all
        select c_custkey * 2 + 1, c_custkey, upper(c_name), concat('dup-', c_mktsegment)
        from {customer} where c_custkey % 10 = 0""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str, *names: str) -> str:
    """Put the derived views in front of an oracle text."""
    if not names:
        return sql
    parts = [f"{n} as ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {', '.join(parts)}, {body[5:]}"
    return f"with {', '.join(parts)} {body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query and, where there is one, its SQL twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register
