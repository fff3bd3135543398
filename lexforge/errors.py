"""Errors that the engine raises, and the check that does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LexforgeError(Exception):
    """Base of the engine's own errors."""


class RetentionError(LexforgeError):
    """An optimized text retains too little of its original."""


class HttpError(LexforgeError):
    """Answer of a model service other than success; raise it from a model callable to have it handled by its code."""

    def __init__(self, code: int, body: str = "", retry_after: float | None = None):
        super().__init__(f"HTTP {code}: {body}")
        self.code, self.body, self.retry_after = code, body, retry_after


def require_retention(df: DataFrame, least: float, column: str = "retention") -> DataFrame:
    """df as it is, or RetentionError if any row of it retains less than least (null counts as nothing)."""
    short = df.where(F.coalesce(F.col(column), F.lit(0.0)) < least).count()
    if short:
        raise RetentionError(f"{short} rows retain less than {least}")
    return df
