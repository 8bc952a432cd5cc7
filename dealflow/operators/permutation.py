"""Permutation tests of independence on the detail rows themselves.

Every replicate deals the labels out anew among the rows: the rows in the order
of a keyed hash of (seed, replicate, id) get the first label as often as it
occurs, then the second, and so on.  This keeps both margins, and any engine
with MD5 deals the same tables, so p-values can be checked from outside.

Every row is hashed once, and one MD5 serves two replicates; a task hashes many
rows at a time with array operations (``keyedhash``).  Hashes are uniform,
so it is known beforehand where a label's last row about lies: rows between these
windows are only counted (in the task that hashes them), rows inside are kept
with their hashes and ranked.  A window is ``REACH`` standard deviations wide to
each side, so its rows grow with the square root of the table.  Running counts
show whether a label does end in its window; replicates where it does not (ids
shared by many rows) are dealt again with wider windows, up to the whole range.

The work is rows x replicates.  For tables far beyond that,
:func:`dealflow.operators.stats.chi_square_mc` draws tables from the margins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from dealflow.operators.keyedhash import draws
from dealflow.session import checkpointed

# Usual replicate counts of the two tests.
REPLICATES = {"chisq": 10000, "fisher": 2000}
MOST_LABELS = 100          # labels are columns of the counting plan
REACH, WIDER = 5.0, 16     # half a window in standard deviations; its growth if too narrow
# Rows up to which windows are cut at 3, and up to which at 4 hex digits; beyond, at 5.
_BUCKETS = (1 << 21, 1 << 28)


def log_factorial(x: Column) -> Column:
    """log(x!) of a count, by Stirling's series at x + 16 and the 15 factors between."""
    z, x = x.cast("double") + 16, x.cast("double")
    between = x + 1
    for i in range(2, 16):
        between = between * (x + i)
    zz = z * z
    series = ((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
              + (1 / F.lit(12.0) - (1 / F.lit(360.0) - (1 / F.lit(1260.0) - 1 / (1680 * zz)) / zz) / zz) / z)
    return series - F.log(between)


def _part(cells: Sequence[Column], margins: Sequence[int], kind: str) -> Column:
    """A table row's part of the statistic: chi-square terms, or minus the log
    probability up to a constant.  Larger is more extreme in both."""
    if kind == "fisher":
        return sum((log_factorial(c) for c in cells), F.lit(0.0))
    here, total = sum(cells[1:], cells[0]).cast("double"), float(sum(margins))
    out = F.lit(0.0)
    for c, m in zip(cells, margins):
        e = here * F.lit(float(m)) / F.lit(total)
        out = out + (c - e) * (c - e) / e
    return out


def permutation_test(df: DataFrame, row: str, col: str, kind: str = "chisq", id_col: str = "id",
                     replicates: int | None = None, seed: int = 0) -> DataFrame:
    """One row: statistic, df, replicates, n_extreme, p_value.

    ``kind`` is ``chisq`` (Pearson's statistic) or ``fisher`` (minus the log of
    the table's probability, up to a constant).  ``n_extreme`` counts the
    replicates at least as extreme as the table of ``df``, up to rounding;
    ``p_value`` is (1 + n_extreme) / (replicates + 1).  A null ``row`` is a group,
    rows with a null ``col`` do not count.  Rows are told apart by ``id_col``;
    equal ids with equal labels share their draws.
    """
    replicates = REPLICATES[kind] if replicates is None else replicates
    # Each of these narrow rows is hashed once for every two replicates, so they
    # are spread over all cores first.
    rows = checkpointed(df.where(F.col(col).isNotNull()).select(
        F.col(row).alias("_row"), F.col(col).alias("_label"), F.col(id_col).cast("string").alias("_id"))
        .repartition(2 * df.sparkSession.sparkContext.defaultParallelism))
    margins = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n"))
               .orderBy("_label").limit(MOST_LABELS + 1).collect()}
    if len(margins) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different values of {col}")
    labels, sizes = list(margins), list(margins.values())
    if len(labels) < 2:
        raise ValueError(f"needs two or more values of {col}")
    observed = rows.groupBy("_row").agg(*[F.count_if(F.col("_label") == v).alias(f"_x{j}") for j, v in enumerate(labels)])
    cells = [F.col(f"_x{j}") for j in range(len(labels))]
    found = observed.agg(F.count(F.lit(1)).alias("n"), F.sum(_part(cells, sizes, kind)).alias("s")).first()
    if found["n"] < 2:
        raise ValueError(f"needs two or more values of {row}")
    # Equal tables may differ by rounding: chi-square relative, log probability absolute.
    slack = 1e-9 * max(1.0, found["s"]) if kind == "chisq" else 1e-7 + 1e-14 * abs(found["s"])
    dealt = _dealt_tables(rows, sizes, replicates, seed)
    extreme = (dealt.groupBy("_r").agg(F.sum(_part(cells, sizes, kind)).alias("_s"))
               .where(F.col("_s") >= F.lit(found["s"] - slack)))
    return extreme.agg(F.count(F.lit(1)).alias("n_extreme")).select(
        F.lit(found["s"]).alias("statistic"), F.lit((found["n"] - 1) * (len(labels) - 1)).cast("long").alias("df"),
        F.lit(replicates).cast("long").alias("replicates"), "n_extreme",
        ((F.col("n_extreme") + 1) / F.lit(replicates + 1)).alias("p_value"))


def _windows(sizes: Sequence[int], reach: float) -> list[tuple[str, str | None]]:
    """Disjoint intervals of hashes [low, high) in which the labels but the last
    end, by their leading hex digits; None is the end of the range."""
    total = sum(sizes)
    digits = 3 + sum(total > bound for bound in _BUCKETS)
    most = 16 ** digits
    out: list[tuple[int, int]] = []
    for j in range(len(sizes) - 1):
        share = sum(sizes[:j + 1]) / total
        half = reach * math.sqrt(share * (1 - share) / total) + reach / total
        low, high = max(0, math.floor((share - half) * most)), min(most, math.ceil((share + half) * most))
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return [(f"{low:0{digits}x}", f"{high:0{digits}x}" if high < most else None) for low, high in out]


def _edge(digits: str | None) -> int | None:
    """A hash's leading 32 bits at its leading hex digits."""
    return None if digits is None else int(digits, 16) << (32 - 4 * len(digits))


def _dealt_tables(rows: DataFrame, sizes: Sequence[int], replicates: int, seed: int) -> DataFrame:
    """(_r, _row, _x0, _x1, ...): how often each label fell to each table row."""
    ends = [sum(sizes[:j + 1]) for j in range(len(sizes))]
    turns: Sequence[int] = range((replicates + 1) // 2)
    wanted, reach, pieces = None, REACH, []
    while True:
        windows = _windows(sizes, reach)
        counts = checkpointed(_counted(rows, turns, windows, replicates, seed))
        if wanted is not None:
            counts = counts.join(F.broadcast(wanted), "_r")  # a number for each replicate
        # The running count before a zone, and the labels that end in its middle.
        zones = counts.groupBy("_r", "_z").agg(F.sum("_n").alias("_n")).withColumn(
            "_first", F.sum("_n").over(Window.partitionBy("_r").orderBy("_z")) - F.col("_n"))
        zones = checkpointed(zones.withColumn("_open", (F.col("_z") % 2 == 0) & F.exists(
            F.array(*[F.lit(e) for e in ends]),
            lambda e: (e > F.col("_first")) & (e < F.col("_first") + F.col("_n")))))
        missed = checkpointed(zones.groupBy("_r").agg(F.max("_open").alias("_open")).where("_open").select("_r"))
        pieces.append(_split(counts.join(F.broadcast(missed), "_r", "left_anti"), zones, ends))
        if missed.isEmpty():
            break
        wanted, reach = missed, reach * WIDER
        # no more than there are replicates, which is a parameter
        turns = sorted({r["_r"] // 2 for r in missed.collect()})
    every = pieces[0]
    for p in pieces[1:]:
        every = every.unionByName(p)
    return every


def _counted(rows: DataFrame, turns: Sequence[int], windows: Sequence[tuple[str, str | None]], replicates: int,
             seed: int) -> DataFrame:
    """(_r, _z, _k, _id, _row, _n): rows counted by zone (0 before the first window,
    1 inside it, 2 behind it, and so on), inside windows one by one with hash and id."""
    edges = [_edge(e) for w in windows for e in w]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return draws(batches, turns, edges, replicates, seed)

    narrow = rows.select("_row", "_id")
    return narrow.mapInArrow(draw, StructType([
        StructField("_r", IntegerType()), StructField("_z", IntegerType()), StructField("_k", LongType()),
        StructField("_id", StringType()), StructField("_row", narrow.schema["_row"].dataType),
        StructField("_n", LongType())]))


def _split(counts: DataFrame, zones: DataFrame, ends: Sequence[int]) -> DataFrame:
    """The rows of every zone in their order, dealt to the labels whose places they take."""
    order = Window.partitionBy("_r", "_z").orderBy("_k", "_id", "_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(zones.select("_r", "_z", "_first"), ["_r", "_z"]).withColumn(
        "_from", F.col("_first") + F.sum("_n").over(order) - F.col("_n"))
    edges = [0, *ends]
    share = [F.greatest(F.least(F.col("_from") + F.col("_n"), F.lit(b)) - F.greatest("_from", F.lit(a)), F.lit(0))
             for a, b in zip(edges, edges[1:])]
    return placed.groupBy("_r", "_row").agg(*[F.sum(x).alias(f"_x{j}") for j, x in enumerate(share)])
