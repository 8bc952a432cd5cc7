"""Column profiles by type (numeric, categorical, date, boolean) and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.operators.joins import lookup_join
from dealflow.operators.ordering import grouped_quantiles, row_id
from dealflow.session import checkpointed


def factor_codes(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """1-based code of each value among the sorted distinct values (NULL stays
    NULL). Levels are numbered by the distributed row-id helper, then joined
    back (broadcast only when the level table is small)."""
    name = name or f"{column}_code"
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    coded = row_id(levels, [column], name)
    return lookup_join(df, coded, column, column, how="left", null_safe=False)


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
QUANTILE_NAMES = ("p0", "p25", "p50", "p75", "p100")
QUANTILE_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    test = {
        "numeric": lambda t: isinstance(t, _NUMERIC),
        "categorical": lambda t: isinstance(t, T.StringType),
        "date": lambda t: isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)),
        "boolean": lambda t: isinstance(t, T.BooleanType),
    }[kind]
    return [f.name for f in df.schema.fields if test(f.dataType)]


def _present(df: DataFrame, c: str) -> Column:
    """The column with NaN turned into NULL (both count as missing)."""
    col = F.col(c)
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    return col


def _base(df: DataFrame, cols: list[str], extra) -> DataFrame:
    """One aggregation pass: n_missing, complete_rate and ``extra(c)`` for
    every column, returned long (one row per column)."""
    n = F.count(F.lit(1))
    aggs = [n.alias("__n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(_present(df, c).isNull()).alias(f"__m{i}"))
        for name, expr in extra(c):
            aggs.append(expr.alias(f"__{name}{i}"))
    row = df.agg(*aggs)
    names = [name for name, _ in extra(cols[0])] if cols else []  # may be empty
    structs = []
    for i, c in enumerate(cols):
        fields = [F.lit(c).alias("skim_variable"), F.col(f"__m{i}").alias("n_missing"),
                  (1 - F.col(f"__m{i}") / F.col("__n")).alias("complete_rate")]
        fields += [F.col(f"__{name}{i}").alias(name) for name in names]
        structs.append(F.struct(*fields))
    return row.select(F.inline(F.array(*structs)))


def long_values(df: DataFrame, cols: list[str], cast: str | None = None) -> DataFrame:
    """(skim_variable, value) rows for the given columns, one pass over ``df``;
    NaN becomes NULL."""
    def v(c):
        x = _present(df, c)
        return x.cast(cast) if cast else x
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("skim_variable"), v(c).alias("value")) for c in cols])))


def profile_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """skim_variable, n_missing, complete_rate, mean, sd, p0, p25, p50, p75, p100.

    Moments of all columns come from one aggregation pass; exact quantiles of
    all columns from one grouped-quantile pass over the unpivoted values (a
    column is a group, so a column with unbounded distinct values is handled
    by distributed rank selection rather than one task).
    """
    cols = cols or columns_of_type(df, "numeric")
    base = _base(df, cols, lambda c: [
        ("mean", F.avg(_present(df, c).cast("double"))),
        ("sd", F.stddev_samp(_present(df, c).cast("double")))])
    qs = grouped_quantiles(long_values(df, cols, "double"), ["skim_variable"], "value",
                           QUANTILE_PROBS, QUANTILE_NAMES)
    return base.join(qs, "skim_variable", "left")


def _top_counts(counts: DataFrame, k: int) -> DataFrame:
    """(skim_variable, top_counts): each column's ``k`` most frequent values (ties
    by value), from one ranking of all columns. Spark keeps the first ``k`` of a
    column in every task before it brings them together."""
    order = Window.partitionBy("skim_variable").orderBy(F.col("n").desc(), F.col("value").asc())
    top = counts.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)
    items = F.sort_array(F.collect_list(F.struct("__rank", "value", "n")))
    return top.groupBy("skim_variable").agg(
        F.transform(items, lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n"))).alias("top_counts"))


def profile_categorical(df: DataFrame, cols: list[str] | None = None, top: int = 4) -> DataFrame:
    """skim_variable, n_missing, complete_rate, n_unique, top_counts.

    Value counts of all columns come from one pass over the unpivoted values
    (checkpointed); each column's distinct count and top values are read from
    that table, instead of a multi-distinct aggregation that would replicate
    every row once per column into the shuffle.
    """
    cols = cols or columns_of_type(df, "categorical")
    base = _base(df, cols, lambda c: [])
    counts = checkpointed(long_values(df, cols).where(F.col("value").isNotNull())
                          .groupBy("skim_variable", "value").agg(F.count(F.lit(1)).alias("n")))
    uniq = counts.groupBy("skim_variable").agg(F.count(F.lit(1)).alias("n_unique"))
    tops = _top_counts(counts, top)
    return (base.join(uniq, "skim_variable", "left").join(tops, "skim_variable", "left")
            .withColumn("n_unique", F.coalesce(F.col("n_unique"), F.lit(0))))


def profile_date(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """skim_variable, n_missing, complete_rate, min, max, median, n_unique.

    The median of an even count falls between two days; it is floored to a day.
    Distinct count and median of all columns come from one grouped pass.
    """
    cols = cols or columns_of_type(df, "date")
    base = _base(df, cols, lambda c: [
        ("min", F.min(F.col(c).cast("date"))), ("max", F.max(F.col(c).cast("date")))])
    days = long_values(df.select(*[F.unix_date(F.col(c).cast("date")).alias(c) for c in cols]), cols)
    med = grouped_quantiles(days, ["skim_variable"], "value", [0.5], ["__med"],
                            distinct_name="n_unique")
    med = med.select("skim_variable", "n_unique",
                     F.date_from_unix_date(F.floor("__med").cast("int")).alias("median"))
    return (base.join(med, "skim_variable", "left")
            .withColumn("n_unique", F.coalesce(F.col("n_unique"), F.lit(0))))


def profile_boolean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """skim_variable, n_missing, complete_rate, mean (share TRUE), n_true, n_false."""
    cols = cols or columns_of_type(df, "boolean")
    return _base(df, cols, lambda c: [
        ("mean", F.avg(F.col(c).cast("double"))),
        ("n_true", F.count_if(F.col(c))),
        ("n_false", F.count_if(~F.col(c)))])


def skim(df: DataFrame) -> dict[str, DataFrame]:
    """Profiles of every column, one table per type family present."""
    out = {}
    for kind, fn in (("numeric", profile_numeric), ("categorical", profile_categorical),
                     ("date", profile_date), ("boolean", profile_boolean)):
        if columns_of_type(df, kind):
            out[kind] = fn(df)
    return out
