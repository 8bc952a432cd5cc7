"""Rule and group-statistic imputation with an audit flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.functions.scalars import if_else_null, round_half_even
from dealflow.operators.aggregates import count_where
from dealflow.operators.columns import mutate
from dealflow.operators.joins import attach_group_stat
from dealflow.operators.ordering import grouped_quantiles

_NEEDS = "__needs_imputation"


def impute_by_rule(df: DataFrame, target: str, fallback: str | Column, when: Column,
                   flag: str = "imputed_last_stage") -> DataFrame:
    """Where ``when`` holds, set ``target`` from ``fallback`` and the flag TRUE.

    A NULL condition leaves both the value and the flag NULL. The flag column
    is created FALSE if it does not exist yet.
    """
    fb = F.col(fallback) if isinstance(fallback, str) else fallback
    if flag not in df.columns:
        df = df.withColumn(flag, F.lit(False))
    return mutate(
        df,
        (_NEEDS, when),
        (target, if_else_null(F.col(_NEEDS), fb, F.col(target))),
        (flag, if_else_null(F.col(_NEEDS), F.lit(True), F.col(flag))),
    ).drop(_NEEDS)


def impute_entry_stage(df: DataFrame, target: str = "last_stage_change_date",
                       fallback: str = "created_date", group: str = "stage",
                       entry_value: str = "NEW", flag: str = "imputed_last_stage") -> DataFrame:
    """Missing date of a deal still in the entry stage := its created date."""
    when = (F.col(group) == F.lit(entry_value)) & F.col(target).isNull()
    return impute_by_rule(df, target, fallback, when, flag)


def group_median_lag(df: DataFrame, group: str = "stage", start: str = "created_date",
                     end: str = "last_stage_change_date",
                     name: str = "median_days_to_stage") -> DataFrame:
    """Exact median of whole days from ``start`` to ``end`` per group, over rows
    with ``end`` present (see ``grouped_quantiles`` for how hot groups are
    kept out of a single task)."""
    days = (df.where(F.col(end).isNotNull())
            .select(group, F.datediff(F.col(end), F.col(start)).cast("double").alias("__days")))
    return grouped_quantiles(days, [group], "__days", [0.5], [name])


def impute_by_group_median(df: DataFrame, stats: DataFrame, group: str = "stage",
                           target: str = "last_stage_change_date",
                           start: str = "created_date", skip_value: str = "NEW",
                           stat: str = "median_days_to_stage",
                           flag: str = "imputed_last_stage") -> DataFrame:
    """Missing ``target`` := ``start`` + round-half-even(group median days).

    Rows in ``skip_value`` are left alone; a group without a median keeps its
    NULL date but is still flagged. The per-group table is broadcast after a
    size check.
    """
    joined = attach_group_stat(df, stats, group)
    when = F.col(target).isNull() & (F.col(group) != F.lit(skip_value))
    shifted = F.date_add(F.col(start), round_half_even(F.col(stat), 0).cast("int"))
    return impute_by_rule(joined, target, shifted, when, flag).drop(stat)


def imputation_summary(df: DataFrame, flag: str = "imputed_last_stage",
                       target: str = "last_stage_change_date") -> DataFrame:
    return df.groupBy(flag).agg(
        F.count(F.lit(1)).alias("total_deals"),
        count_where(F.col(target).isNull()).alias("missing_dates_remaining"),
    )
