"""Registered queries: each runs over whole tables and has a SQL twin where one exists."""

from queries import conversion, filters, jobs, lookups, merges, scans, targets
from queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "conversion", "filters", "jobs", "lookups", "merges", "scans", "targets"]
