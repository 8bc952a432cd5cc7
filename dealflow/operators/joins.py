"""Lookup joins: a checked broadcast, else a shuffle join whose hot keys are split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.session import checkpointed

# Largest lookup we broadcast without asking the planner: bytes as measured on
# its rows, and rows. Above it the join shuffles, with hot keys split (see
# ``split_hot_keys``).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
BROADCAST_MAX_ROWS = 2_000_000


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in a broadcast table: 16, 8 per column, and the contents
    of strings (other types of variable length by their text form)."""
    total = F.lit(16 + 8 * len(df.columns))
    for f in df.schema.fields:
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType,
                                       T.TimestampNTZType)):
            text = F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(
                F.struct(f"`{f.name}`"))
            total = total + F.coalesce(F.octet_length(text), F.lit(0))
    return total


def maybe_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its first rows prove it small: at most
    ``max_rows`` of them, and at most ``BROADCAST_MAX_BYTES`` measured."""
    bound = BROADCAST_MAX_ROWS if max_rows is None else max_rows
    if bound <= 0:
        return df
    rows, size = df.limit(bound + 1).agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return F.broadcast(df) if rows <= bound and (size or 0) <= BROADCAST_MAX_BYTES else df


# A key is hot if it has more rows than half the even share of a task; each hot
# key is split so that a piece has at most an eighth of that share.
HOT_SHARE, PIECES = 2, 8
MOST_TRACKED = 1 << 17  # counters of the summary; it is mergeable, so of one task each


def hot_keys(df: DataFrame, key_hash: Column, parts: int) -> list[tuple[int, int]]:
    """(hash of the key, pieces) of the hot keys, NULL ones included.

    One pass: every task keeps a frequent-items summary, and the summaries are
    merged. A key above the bound cannot be missed: the summary tracks at least
    16 keys for each task's share. At most ``HOT_SHARE * parts`` keys are hot.
    """
    tracked = min(max(1024, 1 << (16 * parts - 1).bit_length()), MOST_TRACKED)
    most = min(HOT_SHARE * parts, tracked)
    row = df.select(key_hash.alias("_h")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {most}, {tracked})").alias("top")).first()
    share = row["n"] / parts
    return [(t["item"], min(PIECES * parts, -(-PIECES * t["count"] // max(1, int(share)))))
            for t in row["top"] or [] if t["count"] * HOT_SHARE > share]


def split_hot_keys(left: DataFrame, right: DataFrame, left_keys: Sequence[str],
                   right_keys: Sequence[str]) -> tuple[DataFrame, DataFrame, str | None]:
    """Both sides with a salt column that spreads the hot keys of ``left``.

    A detail row of a hot key draws one of its pieces from a hash of the whole row
    and its partition (the same in every retry); the lookup rows of that key are
    repeated once per piece. Other rows have salt 0. Without hot keys nothing
    is added and the salt's name is None.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(left, F.xxhash64(*[F.col(f"`{k}`") for k in left_keys]), parts)
    if not hot:
        return left, right, None
    pieces = F.broadcast(spark.createDataFrame(hot, "_hot_h long, _hot_n int"))  # at most 2 * parts rows

    def marked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        own = df.withColumn("_hot_k", F.xxhash64(*[F.col(f"`{k}`") for k in keys]))
        return own.join(pieces, F.col("_hot_k") == F.col("_hot_h"), "left").withColumn(
            "_hot_n", F.coalesce("_hot_n", F.lit(1))).drop("_hot_k", "_hot_h")

    whole = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if _hashable(left.schema[c].dataType)],
                       F.spark_partition_id())
    dealt = left.withColumn("_hot_w", whole)
    detail = marked(dealt, left_keys).withColumn("_salt", F.pmod("_hot_w", F.col("_hot_n")).cast("int")).drop("_hot_n", "_hot_w")
    lookup = marked(right, right_keys).withColumn(
        "_salt_r", F.explode(F.sequence(F.lit(0), F.col("_hot_n") - 1))).drop("_hot_n")
    return detail, lookup, "_salt"


def _hashable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def lookup_join(left: DataFrame, right: DataFrame, left_on: str | Sequence[str],
                right_on: str | Sequence[str] | None = None, how: str = "left",
                null_safe: bool = True, keep_right_key: bool = False,
                max_broadcast_rows: int | None = None) -> DataFrame:
    """Join ``right`` onto ``left`` by keys that may be named differently.

    NULL keys match each other (``null_safe``), as in the analysis this
    reproduces. Right keys are dropped unless asked for; duplicate right keys
    multiply left rows, as any join does. A lookup that is not proven small is
    shuffled, with the hot keys of ``left`` split over many tasks (joins that
    keep every left row or only matches; others are left to Spark).
    """
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = lk if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    r = right
    renamed = []
    for k in rk:
        tmp = f"__rk_{k}"
        r = r.withColumnRenamed(k, tmp)
        renamed.append(tmp)
    lookup = maybe_broadcast(r, max_broadcast_rows)
    salt = None
    if lookup is r and how in ("left", "left_outer", "inner"):
        left, lookup, salt = split_hot_keys(left, r, lk, renamed)
    cond = None
    for a, b in zip(lk, renamed):
        c = left[a].eqNullSafe(lookup[b]) if null_safe else (left[a] == lookup[b])
        cond = c if cond is None else cond & c
    if salt:
        cond = cond & (left[salt] == lookup["_salt_r"])
    out = left.join(lookup, cond, how).drop("_salt", "_salt_r")
    if keep_right_key:
        for k, tmp in zip(rk, renamed):
            out = out.withColumnRenamed(tmp, k)
        return out
    return out.drop(*renamed)


def attach_group_stat(detail: DataFrame, stats: DataFrame, keys: str | Sequence[str],
                      max_broadcast_rows: int | None = None) -> DataFrame:
    """Left-join a per-group aggregate back onto its detail rows (NULL group
    matches NULL group). Preferred over a window, which would send every row
    of a group to one task.

    The aggregate is checkpointed first, so it is computed once and its size
    check reads stored rows; it is broadcast only when that check passes,
    otherwise both sides are shuffled on the keys.
    """
    stats = checkpointed(stats)
    return lookup_join(detail, stats, keys, keys, "left", True, False, max_broadcast_rows)


def join_small(left: DataFrame, right: DataFrame, keys: str | Sequence[str],
               how: str = "left") -> DataFrame:
    """Join two per-group results (small tables) on their group keys, NULL
    matching NULL, keeping one copy of the keys."""
    return lookup_join(left, right, keys, keys, how, True, False)
