"""Spark-native moving and reconciling of tables."""

from rowferry.errors import ConfigError, ConflictError, FerryError, JobError, NotFoundError, SourceError
from rowferry.functions.exprs import Gen, col, concat, lit, template
from rowferry.functions.predicates import (
    between,
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
from rowferry.operators.mapping import Rule, auto_match, auto_rules
from rowferry.plans.mapping_job import (
    ABORT_ON_FIRST,
    SKIP_AND_REPORT,
    MappingJob,
    abort_on_error_rate,
    run_mapping,
)
from rowferry.plans.work import Work, run_works
from rowferry.session import session
from rowferry.sources.versions import VersionedTable
from rowferry.types import Kind

__all__ = [
    "ABORT_ON_FIRST", "ConfigError", "ConflictError", "FerryError", "Gen", "JobError", "Kind", "MappingJob",
    "NotFoundError", "Rule", "SKIP_AND_REPORT", "SourceError", "VersionedTable", "Work", "abort_on_error_rate",
    "auto_match", "auto_rules", "between", "col", "concat", "eq", "ge", "gt", "in_", "is_empty",
    "le", "like", "lit", "lt", "ne", "not_between", "not_empty", "not_in", "not_like",
    "run_mapping", "run_works", "session", "template",
]
