"""Contingency tables, chi-square, Monte-Carlo exact tests, rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.operators.aggregates import count_where
from dealflow.operators.joins import join_small, maybe_broadcast
from dealflow.operators.montecarlo import count_extreme, fisher_2x2
from dealflow.operators.ordering import mid_ranks_of
from dealflow.session import checkpointed


def contingency(df: DataFrame, row: str, col: str, values: Sequence[str],
                count: str = "n") -> DataFrame:
    """Long (row, col, n) table with explicit zeros for absent cells, over
    rows whose ``col`` is one of ``values``; columns with a zero margin are
    dropped. One shuffle (conditional counts) into a stored table of labels; all
    later steps work on that."""
    sub = df.where(F.col(col).isin(list(values)))
    wide = checkpointed(sub.groupBy(row).agg(
        *[count_where(F.col(col) == v).alias(str(v)) for v in values]))
    margins = wide.agg(*[F.sum(str(v)).alias(str(v)) for v in values]).first()
    kept = [str(v) for v in values if (margins[str(v)] or 0) > 0]
    if not kept:
        return wide.select(row, F.lit(None).cast("string").alias(col),
                           F.lit(None).cast("long").alias(count)).where(F.lit(False))
    return wide.unpivot([row], kept, col, count)


def chi_square(long: DataFrame, row: str, col: str, count: str = "n") -> DataFrame:
    """Pearson statistic (no continuity correction) and degrees of freedom
    from a long contingency table. Margins are grouped sums joined back to the
    cells and the grand total a scalar: no window over the table."""
    total = long.agg(F.sum(count)).first()[0] or 0
    rt = long.groupBy(row).agg(F.sum(count).alias("_rt"))
    ct = long.groupBy(col).agg(F.sum(count).alias("_ct"))
    cells = (join_small(join_small(long, rt, row), ct, col)
             .select(row, col, F.col(count).cast("double").alias("_o"),
                     (F.col("_rt").cast("double") * F.col("_ct").cast("double") / F.lit(float(total)))
                     .alias("_e")))
    return cells.agg(
        F.sum((F.col("_o") - F.col("_e")) ** 2 / F.col("_e")).alias("statistic"),
        ((F.count_distinct(F.struct(row)) - 1) * (F.count_distinct(F.struct(col)) - 1))
        .cast("long").alias("df"))


def _table_rows(long: DataFrame, row: str, col: str, count: str) -> tuple[DataFrame, int, list]:
    """The table as stored (key, cells) rows without zero margins; its number
    of rows, and the column labels (outcomes, a handful)."""
    labels = [r[0] for r in long.groupBy(col).agg(F.sum(count).alias("n")).where("n > 0")
              .orderBy(col).collect()]
    cells = F.array(*[F.coalesce(F.sum(F.when(F.col(col).eqNullSafe(F.lit(v)), F.col(count))), F.lit(0)).cast("long")
                      for v in labels]) if labels else F.array().cast("array<bigint>")
    rows = (long.groupBy(row).agg(cells.alias("cells"))
            .where(F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c) > 0)
            .select(F.coalesce(F.to_json(F.struct(row)), F.lit("")).alias("key"), "cells"))
    rows = checkpointed(rows)
    n = rows.count()
    if n < 2 or len(labels) < 2:
        raise ValueError("needs at least a 2 x 2 table with non-zero margins")
    return rows, n, labels


def chi_square_mc(spark: SparkSession, long: DataFrame, row: str, col: str,
                  count: str = "n", replicates: int = 10000, seed: int = 0,
                  partitions: int | None = None) -> DataFrame:
    """Chi-square test with a Monte-Carlo p-value: (1 + #{sim >= obs}) / (B + 1).

    Tables of any size and counts of any size; the p-value does not depend on
    ``partitions`` (default: the cluster's parallelism)."""
    rows, n, labels = _table_rows(long, row, col, count)
    hits, stat = count_extreme(spark, rows, replicates, seed, "chisq", partitions)
    return spark.createDataFrame(
        [(stat, (n - 1) * (len(labels) - 1), (1 + hits) / (replicates + 1), replicates, seed)],
        "statistic double, df long, p_value double, replicates long, seed long")


def fisher_mc(spark: SparkSession, long: DataFrame, row: str, col: str,
              count: str = "n", replicates: int = 2000, seed: int = 0,
              partitions: int | None = None) -> DataFrame:
    """Fisher's exact test: exact for 2 x 2, otherwise Monte-Carlo with the
    table probability (product of 1 / x!) as statistic."""
    rows, n, labels = _table_rows(long, row, col, count)
    if n == 2 and len(labels) == 2:
        (a, b), (c, d) = (r.cells for r in rows.orderBy("key").collect())
        return spark.createDataFrame([(fisher_2x2(spark, a, b, c, d), "exact", 0, seed)],
                                     "p_value double, method string, replicates long, seed long")
    hits, _ = count_extreme(spark, rows, replicates, seed, "fisher", partitions)
    return spark.createDataFrame([((1 + hits) / (replicates + 1), "simulated", replicates, seed)],
                                 "p_value double, method string, replicates long, seed long")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rho over complete pairs with mid-ranks for ties.

    Pairs are counted first (map-side combined), so a value that many rows
    share is one row per distinct pair; both rank tables come from those
    counts, and rho from sums weighted by them.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(
        F.col(y).cast("double"))
    pairs = checkpointed(df.where(ok).groupBy(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
                         .agg(F.count(F.lit(1)).alias("_n")))
    rx, ry = mid_ranks_of(pairs, [x, y], ["_rx", "_ry"], weight="_n")
    ranked = pairs.join(maybe_broadcast(rx), x).join(maybe_broadcast(ry), y)
    total = pairs.agg(F.sum("_n")).first()[0] or 0
    middle = F.lit((total + 1) / 2.0)  # the mean of all mid-ranks
    u, v, n = F.col("_rx") - middle, F.col("_ry") - middle, F.col("_n")
    return ranked.agg(
        F.try_divide(F.sum(n * u * v), F.sqrt(F.sum(n * u * u) * F.sum(n * v * v))).alias("rho"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_pairs"))
