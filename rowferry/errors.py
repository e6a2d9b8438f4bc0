"""Exceptions raised before or while a job runs; Spark's own errors pass through."""


class FerryError(Exception):
    code = "ETL_ERROR"


class ConfigError(FerryError, ValueError):
    """A job description that cannot run: caught before any Spark job starts."""

    code = "CONFIG_ERROR"


class SourceError(FerryError):
    """A source that cannot be read as asked."""

    code = "FILE_ERROR"


class NotFoundError(FerryError):
    """A table, column or stored job that does not exist."""

    code = "NOT_FOUND"


class JobError(FerryError):
    """A job that started and had to stop."""

    code = "ETL_ERROR"


class ConflictError(JobError):
    """Another writer changed the target first."""
