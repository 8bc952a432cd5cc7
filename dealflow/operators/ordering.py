"""Order-dependent building blocks that stay distributed.

Spark has no cheap global running count: an unpartitioned window sends every
row to one task. These helpers range-partition the data, checkpoint it (which
fixes partition ids and makes recomputation after a lost executor consistent),
sum up each partition, and join the running totals back as data: a table of one
row per partition, itself summed in two levels, so that neither a plan nor a
task grows with the number of partitions. Running sums inside a partition use a
window over that partition only; range partitioning of distinct values keeps
those partitions balanced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.session import checkpointed


def _tag_partitions(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    tagged = df.orderBy(*order).select(
        "*",
        F.spark_partition_id().alias("_ord_p"),
        F.monotonically_increasing_id().alias("_ord_m"),
    )
    return checkpointed(tagged)


# Partitions whose totals are added up by one task, and (row, offset) rows of
# partitions that are broadcast: 16 bytes each.
PREFIX_BLOCK = 1024
MOST_BROADCAST_PARTITIONS = 1_000_000


def prefix_table(totals: DataFrame, part: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, part, _ord_off): the sum of ``weight`` over all earlier parts of the
    same keys, stored. Two levels: inside blocks of ``PREFIX_BLOCK`` parts, and over
    the blocks' totals."""
    keys = list(keys)
    block = F.floor(F.col(part) / PREFIX_BLOCK).alias("_ord_g")
    rows = checkpointed(totals.select(*keys, part, weight, block))
    earlier = (Window.partitionBy(*keys, "_ord_g").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(*keys, "_ord_g").agg(F.sum(weight).alias("_ord_t"))
    above = Window.partitionBy(*keys) if keys else Window  # one row per 1024 parts
    above = above.orderBy("_ord_g").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(c).alias(f"_b_{c}") for c in [*keys, "_ord_g"]],
                           F.coalesce(F.sum("_ord_t").over(above), F.lit(0)).alias("_ord_b"))
    same = F.col("_ord_g") == F.col("_b__ord_g")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    inside = rows.withColumn("_ord_i", F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
    return checkpointed(inside.join(blocks, same).select(
        *keys, part, (F.col("_ord_i") + F.col("_ord_b")).cast("long").alias("_ord_off")))


def row_id(df: DataFrame, order: Sequence[Column | str], name: str = "id",
           start: int = 1) -> DataFrame:
    """Dense row number in ``order`` (1-based by default), placed first.

    Equivalent to ``row_number() over (order by ...)`` without funnelling the
    table through one task: rows are range-partitioned and checkpointed, and
    each partition adds the row count of the partitions before it. Ties in
    ``order`` are broken by a hash of the row, so a key shared by many rows
    is spread over many partitions instead of landing in one.
    """
    return _number(_tag_partitions(df, [*order, F.xxhash64(*df.columns)]), df.columns, name, start)


def _number(tagged: DataFrame, columns: Sequence[str], name: str, start: int) -> DataFrame:
    totals = tagged.groupBy("_ord_p").agg(F.count(F.lit(1)).alias("_ord_w"))
    offsets = prefix_table(totals, "_ord_p", "_ord_w")
    if tagged.rdd.getNumPartitions() <= MOST_BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    first_m = F.shiftleft(F.col("_ord_p").cast("long"), 33)  # id of a partition's first row
    out = tagged.join(offsets, "_ord_p").withColumn(name, F.col("_ord_m") - first_m + F.col("_ord_off") + F.lit(start))
    return out.select(name, *[c for c in columns if c != name])


def read_order_id(df: DataFrame, name: str = "id", start: int = 1) -> DataFrame:
    """Dense row number in the order rows are read, placed first: rows are
    stored as they come and counted per partition; nothing is shuffled."""
    tagged = checkpointed(df.select("*", F.spark_partition_id().alias("_ord_p"),
                                    F.monotonically_increasing_id().alias("_ord_m")))
    return _number(tagged, df.columns, name, start)


def keyed_prefix(df: DataFrame, key: str, value: str, weight: str,
                 name: str = "cum_before") -> DataFrame:
    """Add the sum of ``weight`` over all rows of the same ``key`` whose ``value``
    sorts strictly before this row's: one sort for all keys. (key, value) must
    be unique; a NULL key is a key. A key of any size spreads over partitions,
    whose totals per key are joined back (about one row per partition and key)."""
    from dealflow.operators.joins import lookup_join
    tagged = _tag_partitions(df, [F.col(key).asc(), F.col(value).asc()])
    totals = tagged.groupBy(key, "_ord_p").agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_ord_w"))
    joined = lookup_join(tagged, prefix_table(totals, "_ord_p", "_ord_w", [key]), [key, "_ord_p"], how="inner")
    within = (Window.partitionBy("_ord_p", key).orderBy(F.col(value).asc())
              .rowsBetween(Window.unboundedPreceding, -1))
    out = joined.withColumn(name, F.col("_ord_off") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return out.select(*df.columns, name)


def mid_ranks_of(df: DataFrame, columns: Sequence[str], rank_names: Sequence[str],
                 weight: str | None = None) -> list[DataFrame]:
    """Mid-rank tables (value, rank) of several numeric columns from one
    value-count pass and one range sort; a row counts ``weight`` times."""
    cols = list(columns)
    times = F.lit(1).cast("long") if weight is None else F.col(weight)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("_mr_k"), F.col(c).cast("double").alias("_mr_v"), times.alias("_mr_w"))
        for c in cols])))
    counts = (long.where(F.col("_mr_v").isNotNull())
              .groupBy("_mr_k", "_mr_v").agg(F.sum("_mr_w").alias("_mr_n")))
    pref = keyed_prefix(counts, "_mr_k", "_mr_v", "_mr_n", "_mr_cb")
    ranked = pref.select("_mr_k", "_mr_v", (F.col("_mr_cb") + (F.col("_mr_n") + 1) / 2.0).alias("_mr_r"))
    return [ranked.where(F.col("_mr_k") == c).select(F.col("_mr_v").alias(c), F.col("_mr_r").alias(r))
            for c, r in zip(cols, rank_names)]


# Most (group, value) pairs, over all groups, that are merged by Spark's
# percentile: no task can hold more, however groups fall together.
GROUP_STATE_MAX_VALUES = 1_000_000
RADIX_BITS = 12  # leading bits by which a pass of the radix selection narrows


def grouped_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                      probs: Sequence[float], names: Sequence[str],
                      max_values: int | None = None,
                      distinct_name: str | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per group (NULL is a
    group; NULL values are skipped; a group with no values is absent; NaN counts
    as the largest value).

    A first pass stores one row per group: its size, least and greatest value
    and estimated distinct values. If the groups together have at most
    ``max_values`` distinct pairs (by that estimate, which is within 10 %), the
    values are counted and Spark's ``percentile`` with frequencies finishes the
    job. Otherwise a radix selection narrows each wanted rank by leading bits.
    ``df`` is read once per pass, so it should come from a stored table.
    ``distinct_name`` adds the number of distinct values per group.
    """
    groups = list(groups)
    max_values = GROUP_STATE_MAX_VALUES if max_values is None else max_values
    rows = df.where(F.col(value).isNotNull()).select(*groups, value)
    kind = df.schema[value].dataType
    rows = rows.withColumn("_g_k", F.col(value).cast("long") if isinstance(kind, _WHOLE) else order_key(F.col(value)))
    pairs = Observation()
    stats = checkpointed(rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_g_N"), F.min("_g_k").alias("_g_lo"), F.max("_g_k").alias("_g_hi"),
        F.approx_count_distinct(value, 0.02).alias("_g_d")).observe(pairs, F.sum("_g_d").alias("pairs")))
    counts = rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_g_n"))
    if (pairs.get["pairs"] or 0) <= max_values:
        q = F.percentile(F.col(value).cast("double"), list(probs), F.col("_g_n"))
        extra = [F.count(F.lit(1)).alias(distinct_name)] if distinct_name else []
        return counts.groupBy(*groups).agg(q.alias("_g_q"), *extra).select(
            *groups, *[F.col("_g_q")[i].alias(n) for i, n in enumerate(names)],
            *([distinct_name] if distinct_name else []))
    out = _radix_select(rows, stats, groups, value, probs, names)
    if distinct_name:
        from dealflow.operators.joins import join_small
        out = join_small(out, counts.groupBy(*groups).agg(
            F.count(F.lit(1)).alias(distinct_name)), groups)
    return out


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def order_key(value: Column) -> Column:
    """A long that sorts like a double: its exponent and mantissa bits, negated
    for negative numbers. Equal doubles (0.0 and -0.0 too) have equal keys; NaN
    has the greatest. Powers of two are exact, so nothing is rounded."""
    x = value.cast("double")
    a = F.abs(x)
    guess = F.floor(F.log2(a)).cast("int")  # off by one at most
    e = (F.when(F.pow(F.lit(2.0), guess) > a, guess - 1)
         .when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess))
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((a / F.pow(F.lit(2.0), e) - 1) * float(1 << 52)).cast("long")
    key = (F.when(a == float("inf"), F.lit(2047 << 52))
           .when(a >= 2.0 ** -1022, normal)
           .otherwise((a * 2.0 ** 537 * 2.0 ** 537).cast("long")))  # subnormal numbers and zero
    return F.when(F.isnan(x), F.lit((2047 << 52) + 1)).when(x < 0, -key).otherwise(key)


def _radix_select(rows: DataFrame, stats: DataFrame, groups: list[str], value: str,
                  probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Quantiles by narrowing: a wanted rank lies among the rows whose keys share
    some leading bits; counting them by the next ``RADIX_BITS`` bits (partial
    sums in the map tasks) tells which ones it lies among next. A rank is found
    when its bucket holds one value. Each pass reads the rows once and stores
    one row per group and rank; nothing is sorted but the at most 2^RADIX_BITS
    buckets of a rank."""
    from dealflow.operators.joins import maybe_broadcast
    bits = RADIX_BITS
    bounds = [(F.floor((F.col("_g_N") - 1) * F.lit(float(p))), F.ceil((F.col("_g_N") - 1) * F.lit(float(p))))
              for p in probs]
    # all keys of a group share the bits left of this shift, up to 2^(bits - 1) + 1 values
    spread = F.length(F.bin(F.shiftright("_g_hi", 1) - F.shiftright("_g_lo", 1))) + 2 - bits
    shift = F.when(F.shiftright("_g_hi", 1) == F.shiftright("_g_lo", 1), 0).otherwise(F.greatest(spread, F.lit(0)))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(a.cast("long"), b.cast("long")) for a, b in bounds])))
    # A rank's interval: rows whose key shifted by _g_s is _g_b; at first the whole group.
    state = checkpointed(stats.select(
        *groups, F.explode(wanted).alias("_g_rank"), F.lit(None).cast("long").alias("_g_b"),
        F.lit(None).cast("int").alias("_g_s"), shift.cast("int").alias("_g_next"))
        .withColumn("_g_r", F.col("_g_rank")).withColumn("_g_v", F.lit(None).cast("double")))
    open_ = state
    found = []
    while not open_.isEmpty():
        spans = open_.select(*groups, "_g_b", "_g_s", "_g_next").distinct()
        inside = (F.expr("_s__g_s IS NULL OR shiftright(_g_k, _s__g_s) = _s__g_b"))
        for g in groups:
            inside = inside & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
        named = maybe_broadcast(spans.select(*[F.col(c).alias(f"_s_{c}") for c in spans.columns]))
        counts = (rows.join(named, inside)
                  .groupBy(*[F.col(f"_s_{c}") for c in spans.columns],
                           F.expr("shiftright(_g_k, _s__g_next)").alias("_c_b"))
                  .agg(F.count(F.lit(1)).alias("_c_n"), F.min("_g_k").alias("_c_lo"), F.max("_g_k").alias("_c_hi"),
                       F.max(F.col(value).cast("double")).alias("_c_v")))
        before = (Window.partitionBy(*[f"_s_{c}" for c in spans.columns]).orderBy("_c_b")
                  .rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("_c_before", F.coalesce(F.sum("_c_n").over(before), F.lit(0)))
        here = (F.col("_g_r") >= F.col("_c_before")) & (F.col("_g_r") < F.col("_c_before") + F.col("_c_n"))
        for c in spans.columns:
            here = here & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
        state = checkpointed(open_.join(counts, here).select(
            *groups, "_g_rank", F.col("_c_b").alias("_g_b"), F.col("_g_next").alias("_g_s"),
            F.greatest(F.col("_g_next") - bits, F.lit(0)).alias("_g_next"),
            (F.col("_g_r") - F.col("_c_before")).alias("_g_r"),
            F.when(F.col("_c_lo") == F.col("_c_hi"), F.col("_c_v")).alias("_g_v"),
            (F.col("_c_lo") == F.col("_c_hi")).alias("_g_done")))
        found.append(state.where("_g_done").select(*groups, "_g_rank", "_g_v"))
        open_ = state.where("not _g_done").drop("_g_done")
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    sized = stats.select(*[F.col(g).alias(f"_n_{g}") for g in groups], "_g_N")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_n_{g}"))
    aggs = []
    for p, (a, b), nm in zip(probs, bounds, names):
        low, high = (F.max(F.when(F.col("_g_rank") == x, F.col("_g_v"))) for x in (a, b))
        part = F.max((F.col("_g_N") - 1) * F.lit(float(p)) - a)
        aggs.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(nm))
    return values.join(sized, same).groupBy(*groups).agg(*aggs)
