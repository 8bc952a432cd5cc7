"""Grouping, counting, pivoting and whole-table profiles of nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.functions.scalars import is_missing
from dealflow.session import checkpointed


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_where(cond: Column) -> Column:
    """Conditional count; 0 (not NULL) when nothing matches."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def null_profile(df: DataFrame, column_name: str = "column",
                 value_name: str = "n_missing") -> DataFrame:
    """Missing values (NULL, or NaN for floats) of every column, one row each.

    One aggregation pass over the table; the single result row is unpivoted.
    """
    wide = df.agg(*[count_where(is_missing(df, c)).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, column_name, value_name)


def pivot_wider(df: DataFrame, ids: str | Sequence[str], names_from: str,
                values_from: str, values: Sequence, prefix: str = "") -> DataFrame:
    """Long to wide. ``values`` fixes the output columns (and saves the job
    that would otherwise discover them); absent cells are NULL."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    wide = df.groupBy(*ids).pivot(names_from, list(values)).agg(F.first(values_from))
    if prefix:
        for v in values:
            wide = wide.withColumnRenamed(str(v), f"{prefix}{v}")
    return wide


# Most columns that a pivot by the data's own values makes.
MOST_PIVOT_COLUMNS = 1000


def pivot_by_data(df: DataFrame, ids: str | Sequence[str], names_from: str, values_from: str,
                  order: str, prefix: str = "") -> tuple[DataFrame, list]:
    """Long to wide with the columns that the data holds, in the order of their
    first appearance (least ``order``); also returns their values in that order.

    One grouped minimum finds them; more than ``MOST_PIVOT_COLUMNS`` are refused.
    A NULL value is no column. ``df`` is stored, since it is read twice.
    """
    df = checkpointed(df)
    found = (df.where(F.col(names_from).isNotNull()).groupBy(names_from).agg(F.min(order).alias("__first"))
             .orderBy("__first", names_from).limit(MOST_PIVOT_COLUMNS + 1).collect())
    if len(found) > MOST_PIVOT_COLUMNS:
        raise ValueError(f"{names_from} has more than {MOST_PIVOT_COLUMNS} values: too many columns")
    values = [r[names_from] for r in found]
    return pivot_wider(df, ids, names_from, values_from, values, prefix), values


def share_of_total(df: DataFrame, value: str, name: str = "percent",
                   scale: float = 100.0) -> DataFrame:
    """value / sum(value) * scale. ``df`` (usually an aggregate) is computed once
    and stored; the total is a scalar over that, no window over the rows."""
    df = checkpointed(df)
    total = df.agg(F.sum(value)).first()[0]
    return df.withColumn(name, F.try_divide(F.col(value).cast("double"),
                                            F.lit(total).cast("double")) * scale)


def dense_rank_desc(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Dense rank, highest first; a NULL value gets a NULL rank. The distinct
    values are numbered by the distributed row-id helper and joined back."""
    from dealflow.operators.joins import lookup_join
    from dealflow.operators.ordering import row_id
    df = checkpointed(df)
    levels = df.select(value).where(F.col(value).isNotNull()).distinct()
    numbered = row_id(levels, [F.col(value).desc()], name)
    return lookup_join(df, numbered, value, value, how="left", null_safe=False).withColumn(
        name, F.col(name).cast("int"))
