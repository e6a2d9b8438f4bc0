"""Tables, SQL queries, JDBC, and choosing between the sources of a job."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.errors import ConfigError, NotFoundError
from rowferry.functions.sniff import infer_types
from rowferry.functions.text import display
from rowferry.scratch import materialize
from rowferry.sources.files import check_ending, marked_encoding, read_csv
from rowferry.types import Kind, normalize_types, quoted, values_of


@dataclass(frozen=True)
class SourceSpec:
    """A file, or a table or query of a catalog or JDBC connection."""

    path: str | None = None
    table: str | None = None
    query: str | None = None
    encoding: str | None = None
    has_header: bool = True
    jdbc: dict[str, str] = field(default_factory=dict)

    @property
    def is_file(self) -> bool:
        return self.path is not None

    @property
    def label(self) -> str:
        if self.path is not None:
            return self.path.rstrip("/").rsplit("/", 1)[-1]
        return self.query.strip() if self.query else (self.table or "")


def resolve_source(
    declared: SourceSpec | None, default: SourceSpec | None = None, from_table: str | None = None
) -> SourceSpec:
    """The declared source wins; a connection without table or query reads ``from_table``."""
    spec = declared or default
    if spec is None:
        raise ConfigError("no source: name a file, a table or a query")
    if spec.is_file:
        if spec.table or spec.query:
            raise ConfigError(f"[{spec.label}] is a file and takes no table or query")
        return spec
    if spec.table and spec.query:
        raise ConfigError("give a table or a query, not both")
    if not spec.table and not spec.query:
        if not from_table:
            raise ConfigError("a database source needs a table, a query or a FROM table")
        return SourceSpec(table=from_table, jdbc=spec.jdbc)
    return spec


def read_source(spark: SparkSession, spec: SourceSpec, row_no: str | None = None) -> DataFrame:
    if spec.is_file:
        check_ending(spec.path)
        return read_csv(spark, spec.path, spec.encoding, spec.has_header, row_no=row_no)
    if spec.jdbc:
        return normalize_types(read_jdbc(spark, spec.jdbc, spec.table, spec.query))
    return read_table(spark, spec.table) if spec.table else read_query(spark, spec.query)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """A catalog table, or a Parquet folder given by path."""
    if "/" in table:
        return normalize_types(spark.read.parquet(table))
    if not spark.catalog.tableExists(table):
        raise NotFoundError(f"table {table} does not exist")
    return normalize_types(spark.table(table))


def read_query(
    spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None
) -> DataFrame:
    """A SQL query; joins, aggregates, windows and set operations enter here."""
    return normalize_types(spark.sql(query, **(views or {})))


def jdbc_options(
    connection: dict[str, str], table: str | None, query: str | None,
    partition_column: str | None, bounds: tuple | None, partitions: int,
) -> dict[str, str]:
    """Reader options; a partition column turns one query into parallel range queries."""
    if bool(table) == bool(query):
        raise ConfigError("give a table or a query, not both")
    options = {"fetchsize": "10000", **connection}
    options["dbtable"] = table if table else f"({query}) rowferry_source"
    if partition_column:
        if bounds is None:
            raise ConfigError("partition_column needs its lower and upper bound")
        options.update(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return options


def read_jdbc(
    spark: SparkSession,
    connection: dict[str, str],
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    partitions: int = 200,
) -> DataFrame:
    """JDBC read; with ``partition_column`` its bounds are asked first and rows come in parallel."""
    bounds = None
    if partition_column:
        plain = jdbc_options(connection, table, query, None, None, 1)
        probe = f"(select min({partition_column}) lo, max({partition_column}) hi from {plain['dbtable']}) b"
        lo_hi = spark.read.format("jdbc").options(**{**plain, "dbtable": probe}).load().first()
        bounds = (lo_hi[0], lo_hi[1]) if lo_hi[0] is not None else None
    if bounds is None:
        partition_column = None
    options = jdbc_options(connection, table, query, partition_column, bounds, partitions)
    return spark.read.format("jdbc").options(**options).load()


def query_fingerprint(connection: str, query: str) -> str:
    return hashlib.sha256(f"{connection}\n{query}".encode()).hexdigest()


def limit_rows(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows; with ``order_by`` Spark keeps only n per task and merges."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def preview(df: DataFrame, rows: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """The first rows of a source, values as they display."""
    shown = limit_rows(df, rows, order_by)
    return shown.select(*[display(v).alias(n) for n, v in values_of(shown).items()])


def preview_columns(
    df: DataFrame, sample: int | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """``(index, name, inferred_type)`` from all rows, or the first ones of an order."""
    return infer_types(df, sample, order_by)


@dataclass
class SourcePreview:
    """Columns with inferred types, the first rows, the number of all rows if asked for, and the encoding of text."""

    columns: DataFrame
    rows: DataFrame
    total_rows: int | None
    encoding: str | None = None


def source_preview(
    df: DataFrame, rows: int = 100, order_by: list[str] | None = None, count: bool = True,
    sample: int | None = None, encoding: str | None = None,
) -> SourcePreview:
    return SourcePreview(
        preview_columns(df, sample, order_by),
        preview(df, rows, order_by),
        df.count() if count else None,
        encoding,
    )


def file_preview(
    spark: SparkSession, path: str, encoding: str | None = None, has_header: bool = True, rows: int = 100,
    typed: bool = True, count: bool = True,
) -> SourcePreview:
    """The first records of CSV files by path and place, typed from these rows, and the encoding they were read in.

    ``typed`` rows keep their cells (kind and text), others show them as text.
    """
    used = marked_encoding(spark, path) or encoding or "UTF-8"
    cells = read_csv(spark, path, encoding, has_header, row_no="__line")
    # Few rows, kept per task and merged; they are read once for types and rows.
    first = materialize(limit_rows(cells, rows, ["__line"]), "preview")
    names = [c for c in cells.columns if c != "__line"]
    own = first.select(*[F.col(quoted(c)) for c in names])
    shown = first.orderBy("__line").select(*[F.col(quoted(c)) for c in names])
    if not typed:
        shown = shown.select(*[display(v).alias(n) for n, v in values_of(shown).items()])
    return SourcePreview(infer_types(own), shown, cells.count() if count else None, used)


def rows_to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row; dates and times as text, NULLs kept."""
    values = values_of(df)
    if any(v.kind is Kind.CELL for v in values.values()):
        return df.select(_cells_json(values).alias(name))
    columns = [
        (display(v) if v.kind in (Kind.DATETIME, Kind.DATE) else v.column).alias(n)
        for n, v in values.items()
    ]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))


def _cells_json(values) -> "F.Column":
    def text_json(c):
        wrapped = F.to_json(F.array(c))
        return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)

    parts = []
    for i, (n, v) in enumerate(values.items()):
        bare = v.kind in (Kind.INTEGER, Kind.FLOAT, Kind.BOOL)
        shown = display(v)
        if v.kind is Kind.CELL:
            one = F.when(v.column["kind"].isin("integer", "float", "bool"), shown).otherwise(
                text_json(shown)
            )
        else:
            one = shown if bare else text_json(shown)
        label = text_json(F.lit(n))
        value = F.when(v.column.isNull(), F.lit("null")).otherwise(one)
        parts += [F.lit("," if i else "{"), label, F.lit(":"), value]
    return F.concat(*parts, F.lit("}"))


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """``(schema, name)`` of the catalog's tables and views."""
    rows = [
        (".".join(t.namespace or []), t.name) for t in spark.catalog.listTables(database)
    ]
    return spark.createDataFrame(rows, "schema string, name string")


def describe_columns(spark: SparkSession, table: str | DataFrame) -> DataFrame:
    """``(name, native_type, nullable, ordinal)`` of a table or frame; ordinals start at 1."""
    if isinstance(table, str) and "/" not in table and not spark.catalog.tableExists(table):
        raise NotFoundError(f"table {table} does not exist")
    if isinstance(table, str):
        table = spark.read.parquet(table) if "/" in table else spark.table(table)
    rows = [
        (f.name, f.dataType.simpleString(), f.nullable, i)
        for i, f in enumerate(table.schema, start=1)
    ]
    return spark.createDataFrame(
        rows, "name string, native_type string, nullable boolean, ordinal int"
    )


__all__ = [
    "SourcePreview", "SourceSpec", "describe_columns", "file_preview", "jdbc_options", "limit_rows",
    "list_tables", "preview", "preview_columns", "query_fingerprint", "read_jdbc", "read_query",
    "read_source", "read_table", "resolve_source", "rows_to_json", "source_preview",
]
