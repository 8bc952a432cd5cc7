"""Row filters and data-quality gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.functions.scalars import is_missing


def where_missing(df: DataFrame, name: str) -> DataFrame:
    return df.where(is_missing(df, name))


def where_present(df: DataFrame, name: str) -> DataFrame:
    return df.where(~is_missing(df, name))


def where_in(df: DataFrame, name: str, values: Iterable) -> DataFrame:
    """Membership; a NULL value is not a member (a NULL predicate drops the
    row, so the plain IN is exact and can be pushed to the scan)."""
    return df.where(F.col(name).isin(list(values)))


def where_equal(df: DataFrame, name: str, value) -> DataFrame:
    return df.where(F.col(name) == F.lit(value))


def where_below(df: DataFrame, name: str, bound) -> DataFrame:
    """Strict upper bound; NULLs drop out like in SQL."""
    return df.where(F.col(name) < F.lit(bound))


class DataQualityError(ValueError):
    pass


def require_none(df: DataFrame, what: str = "rows") -> DataFrame:
    """Raise when ``df`` has any row (e.g. dates still missing after imputation)."""
    found = df.limit(1).count()
    if found:
        raise DataQualityError(f"expected no {what}, found at least one")
    return df
