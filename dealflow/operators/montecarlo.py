"""Random contingency tables with fixed margins, drawn by Spark tasks.

The table stays a DataFrame: its rows are dealt into blocks by hash, and a
task works on one block of rows and one block of replicates.  What falls to a
block of rows is found by splitting the whole table in halves down to that
block, each split a multivariate hypergeometric draw seeded by (seed, replicate
block, split), so that all tasks agree without exchanging anything.  Inside the
block rows are drawn one after another and only the running statistic of each
replicate is kept.  The driver holds the column margins and one total per
block of ``ROWS_PER_BLOCK`` rows.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# executors need no installed copy of this package: the sampler travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_BLOCK = 4096
REPLICATES_PER_BLOCK = 500
_NUMPY_MOST = 10**9 - 1       # counts beyond this are refused by numpy's sampler
_TIE = 1e-9                   # statistics this close (relative) count as equal

# Sizes of the table-mountain hat of the ratio-of-uniforms method,
# 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e).
_HAT_SCALE, _HAT_SHIFT = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])


def _log_factorial(x: np.ndarray) -> np.ndarray:
    big = np.maximum(x, 256.0)
    series = (big + 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big ** 3)
    return np.where(x < 256, _SMALL[np.minimum(x, 255).astype(int)], series)


def log_factorial_ratio(x, m) -> np.ndarray:
    """log(x! / m!), to full precision also where both are huge and close."""
    x, m = np.broadcast_arrays(np.asarray(x, float), np.asarray(m, float))
    d, big_x, big_m = x - m, np.maximum(x, 256.0), np.maximum(m, 256.0)
    near = ((big_m + 0.5) * np.log1p((big_x - big_m) / big_m) + d * np.log(big_x) - d
            + 1 / (12 * big_x) - 1 / (12 * big_m) - 1 / (360 * big_x ** 3) + 1 / (360 * big_m ** 3))
    return np.where((x >= 256) & (m >= 256), near, _log_factorial(x) - _log_factorial(m))


def _log_weight(x, mode, g, k, b):
    """Log hypergeometric probability of x relative to the mode's."""
    return -(log_factorial_ratio(x, mode) + log_factorial_ratio(g - x, g - mode)
             + log_factorial_ratio(k - x, k - mode) + log_factorial_ratio(b - k + x, b - k + mode))


def _draw_large(rng, good, bad, n):
    """Exact draws for counts of any size: item by item for fewer than ten
    draws (or left-overs), else ratio of uniforms."""
    total = good + bad
    g, k = np.minimum(good, bad), np.minimum(n, total - n)
    b, out = total - g, np.zeros_like(good)
    few = k < 10
    for i in range(9):
        p = (g - out) / np.maximum(total - i, 1)
        out += few & (i < k) & (rng.random(len(g)) < p)
    at = np.flatnonzero(~few)
    while at.size:
        gg, kk, bb, tt = (a[at].astype(float) for a in (g, k, b, total))
        mean = kk * gg / tt
        sd = np.sqrt(mean * (bb / tt) * (tt - kk) / (tt - 1) + 0.5)
        mode = np.floor((kk + 1) * (gg + 1) / (tt + 2))
        u, v = 1 - rng.random(len(at)), rng.random(len(at))
        x = np.floor(mean + 0.5 + (_HAT_SCALE * sd + _HAT_SHIFT) * (v - 0.5) / u)
        inside = (x >= 0) & (x <= np.minimum(gg, kk))
        ok = inside & (2 * np.log(u) <= _log_weight(np.where(inside, x, mode), mode, gg, kk, bb))
        out[at[ok]] = x[ok].astype(np.int64)
        at = at[~ok]
    out = np.where(good > bad, k - out, out)      # counted the rarer kind
    return np.where(k < n, good - out, out)       # counted what is left over


def hypergeometric(rng: np.random.Generator, good, bad, n) -> np.ndarray:
    """Exact hypergeometric draws, element by element."""
    good, bad, n = (a.astype(np.int64) for a in np.broadcast_arrays(good, bad, n))
    small = (good <= _NUMPY_MOST) & (bad <= _NUMPY_MOST) & (good + bad <= _NUMPY_MOST)
    out = np.zeros(good.shape, np.int64)
    out[small] = rng.hypergeometric(good[small], bad[small], n[small])
    if not small.all():
        out[~small] = _draw_large(rng, good[~small], bad[~small], n[~small])
    return out


def split(rng: np.random.Generator, pool: np.ndarray, size: int) -> np.ndarray:
    """``size`` items drawn from each row of ``pool`` (replicates x kinds)."""
    out = np.zeros_like(pool)
    left, need = pool.sum(axis=1), np.full(len(pool), size, np.int64)
    for j in range(pool.shape[1] - 1):
        left = left - pool[:, j]
        out[:, j] = hypergeometric(rng, pool[:, j], left, need)
        need = need - out[:, j]
    out[:, -1] = need
    return out


def row_statistic(x: np.ndarray, n: int, cols: np.ndarray, total: float, kind: str) -> np.ndarray:
    """A table row's part of the statistic; larger is more extreme."""
    expected = float(n) * cols.astype(float) / total
    if kind == "chisq":
        return ((x - expected) ** 2 / expected).sum(axis=-1)
    return log_factorial_ratio(x, np.rint(expected)).sum(axis=-1)


def count_extreme(spark: SparkSession, rows: DataFrame, replicates: int, seed: int, kind: str,
                  partitions: int | None = None) -> tuple[int, float]:
    """(replicates at least as extreme, observed statistic) of a table.

    ``rows``: key (string), cells (array<long>, one per column), no zero row or
    column margins; it should be stored, since it is read several times.
    """
    width = len(rows.select("cells").first()[0])
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(F.col("cells")[j]) for j in range(width)]).first()
    n_rows, cols = sums[0], np.array(sums[1:], np.int64)
    total, blocks = float(cols.sum()), max(1, math.ceil(n_rows / ROWS_PER_BLOCK))
    sized = rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", "cells",
                        F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c).alias("n"))
    per_block = dict(sized.groupBy("block").agg(F.sum("n")).collect())
    sizes = np.array([per_block.get(b, 0) for b in range(blocks)], np.int64)

    def observe(batches):
        for pdf in batches:
            yield pd.DataFrame({"s": [float(row_statistic(np.array(c), n, cols, total, kind))
                                      for c, n in zip(pdf["cells"], pdf["n"])]})

    observed = float(sized.select("cells", "n").mapInPandas(observe, "s double").agg(F.sum("s")).first()[0])
    limit = observed - _TIE * max(1.0, abs(observed))

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rep, block = key
        m = min(REPLICATES_PER_BLOCK, replicates - rep * REPLICATES_PER_BLOCK)
        pool = np.tile(cols, (m, 1))
        low, high = 0, blocks
        while high - low > 1:
            mid = (low + high) // 2
            first = split(np.random.default_rng([seed, rep, low, high]), pool, int(sizes[low:mid].sum()))
            pool, low, high = (first, low, mid) if block < mid else (pool - first, mid, high)
        rng, out = np.random.default_rng([seed, rep, block]), np.zeros(m)
        for n in pdf.sort_values(["n", "key"])["n"].tolist():
            x = split(rng, pool, n)
            pool = pool - x
            out += row_statistic(x, n, cols, total, kind)
        return pd.DataFrame({"replicate": rep * REPLICATES_PER_BLOCK + np.arange(m), "s": out})

    turns = F.sequence(F.lit(0), F.lit(math.ceil(replicates / REPLICATES_PER_BLOCK) - 1))
    dealt = sized.select("block", "key", "n", F.explode(turns).alias("rep"))
    dealt = dealt.repartition(partitions or spark.sparkContext.defaultParallelism, "rep", "block")
    drawn = dealt.groupBy("rep", "block").applyInPandas(draw, "replicate long, s double")
    return drawn.groupBy("replicate").agg(F.sum("s").alias("s")).where(F.col("s") >= limit).count(), observed


def fisher_2x2(spark: SparkSession, a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of [[a, b], [c, d]]: tables no more likely than it.

    The support is a Spark range around the mode, as wide as probabilities
    above the smallest double can be, and summed there.
    """
    good, bad, n = a + c, b + d, a + b
    mean = n * good / (good + bad)
    sd = math.sqrt(max(mean * (bad / (good + bad)) * (c + d) / max(good + bad - 1, 1), 0.0))
    low, high = max(0, n - bad), min(n, good)
    mode = min(max(math.floor((n + 1) * (good + 1) / (good + bad + 2)), low), high)
    reach = math.ceil(40 * sd) + 200
    limit = float(_log_weight(a, mode, good, n, bad)) + 1e-7  # the usual relative tolerance

    def terms(batches):
        for pdf in batches:
            w = _log_weight(pdf["id"].to_numpy(), mode, good, n, bad)
            p = np.exp(w)
            yield pd.DataFrame({"p": [p.sum()], "tail": [p[w <= limit].sum()]})

    r = spark.range(max(low, mode - reach), min(high, mode + reach) + 1).mapInPandas(
        terms, "p double, tail double").agg(F.sum("p"), F.sum("tail")).first()
    return min(1.0, r[1] / r[0])
