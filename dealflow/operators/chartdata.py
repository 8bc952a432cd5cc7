"""The data behind the charts: histogram bins, win-rate bars, box plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.functions.scalars import percent_label
from dealflow.operators.joins import attach_group_stat
from dealflow.operators.ordering import grouped_quantiles, row_id

# Highlight and base bar colours of the win-rate chart.
HIGHLIGHT_FILL, BASE_FILL = "#b96305", "#056875"
# Break fuzz relative to the bin width (keeps values on a break in the lower bin).
_FUZZ = 1e-8


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Fixed-count, right-closed bins of width w = range/(bins-1) whose edges lie
    at odd multiples of w/2; the first edge is the last one not above the minimum.

    Pass 1 gets min and max (one row); pass 2 counts per bin with map-side
    combining. Empty bins come from joining the bin numbers (``bins`` rows).
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    lo, hi = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if lo is None:
        raise ValueError(f"{value}: no values to bin")
    if hi == lo:
        raise ValueError(f"{value}: all values equal ({lo}); bin width would be 0")
    width = (hi - lo) / (bins - 1)
    origin = width / 2 + math.floor((lo - width / 2) / width) * width
    x = F.col(value).cast("double")
    b = F.greatest(F.ceil((x - F.lit(origin)) / F.lit(width) - F.lit(_FUZZ)), F.lit(1))
    counts = (df.where(x.isNotNull()).select(F.least(b, F.lit(bins)).cast("long").alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    frame = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    # counts has at most ``bins`` rows by construction: safe to broadcast
    xmin = F.lit(origin) + (F.col("bin") - 1) * F.lit(width)
    return (frame.join(F.broadcast(counts), "bin", "left")
            .select("bin", xmin.alias("xmin"), (xmin + F.lit(width)).alias("xmax"),
                    (xmin + F.lit(width / 2)).alias("x"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def win_rate_bars(rates: DataFrame, category: str = "team", rate: str = "conversion_rate",
                  highlight: str = "SMB") -> DataFrame:
    """Bar data: axis position ascending by rate (ties by name), percent label,
    highlight flag and fill. Input is one row per category; positions are
    distributed row ids."""
    order = [F.col(rate).asc_nulls_first(), F.col(category).asc_nulls_first()]
    placed = row_id(rates.select(category, rate), order, "axis_pos")
    hl = F.coalesce(F.col(category) == F.lit(highlight), F.lit(False))
    return placed.select(
        category, rate, "axis_pos", percent_label(rate).alias("label"),
        hl.alias("highlight"),
        F.when(hl, F.lit(HIGHLIGHT_FILL)).otherwise(F.lit(BASE_FILL)).alias("fill"))


def _hinges(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    return grouped_quantiles(df.select(*groups, value), list(groups), value,
                             [0.25, 0.5, 0.75], ["lower", "middle", "upper"])


def _with_fences(df: DataFrame, groups: Sequence[str], value: str, coef: float) -> DataFrame:
    h = _hinges(df, groups, value)
    iqr = F.col("upper") - F.col("lower")
    h = h.withColumn("__lo", F.col("lower") - coef * iqr).withColumn(
        "__hi", F.col("upper") + coef * iqr)
    rows = df.where(F.col(value).isNotNull())
    return attach_group_stat(rows, h, list(groups))


def boxplot_stats(df: DataFrame, groups: Sequence[str], value: str,
                  coef: float = 1.5) -> DataFrame:
    """Per group: n, whisker ends (most extreme values within coef*IQR of the
    hinges), hinges, median and the number of outliers. Hinges come from one
    grouped aggregation, are joined back (checked broadcast), then one more
    grouped aggregation computes the whiskers."""
    j = _with_fences(df, groups, value, coef)
    v = F.col(value).cast("double")
    inside = (v >= F.col("__lo")) & (v <= F.col("__hi"))
    return j.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.least(F.min(F.when(inside, v)), F.first("lower")).alias("ymin"),
        F.first("lower").alias("lower"), F.first("middle").alias("middle"),
        F.first("upper").alias("upper"),
        F.greatest(F.max(F.when(inside, v)), F.first("upper")).alias("ymax"),
        F.count_if(~inside).alias("n_outliers"))


def boxplot_outliers(df: DataFrame, groups: Sequence[str], value: str,
                     coef: float = 1.5) -> DataFrame:
    """The rows drawn as outlier points (outside coef*IQR of the hinges)."""
    j = _with_fences(df, groups, value, coef)
    v = F.col(value)
    return j.where((v < F.col("__lo")) | (v > F.col("__hi"))).drop(
        "lower", "middle", "upper", "__lo", "__hi")
