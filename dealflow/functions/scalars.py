"""Scalar column expressions shared by the operators.

All of them build JVM-side expressions; nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date orders tried in turn after separators are normalised to "-".
# The default keeps the single order that is effective in the original
# analysis; the full list is the intended ordered fallback.
DEFAULT_DATE_ORDERS = ("y-M-d",)
FULL_DATE_ORDERS = ("y-M-d", "M-d-y", "d-MMMM-y", "d-MMM-y", "MMMM-y", "MMM-y", "y-M", "y")
# A value must carry a four-digit year to be parsed at all.
_YEAR_GUARD = r"(^|-)[0-9]{4}(-|$)"
# Shape of the normalised text each order can match. Trying an order only on
# values of its shape avoids failed parses, which are slow in the JVM.
_SHAPES = {
    "y-M-d": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "M-d-y": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    "d-MMMM-y": r"^[0-9]{1,2}-[A-Za-z]{4,}-[0-9]{4}$",
    "d-MMM-y": r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$",
    "MMMM-y": r"^[A-Za-z]{4,}-[0-9]{4}$",
    "MMM-y": r"^[A-Za-z]{3}-[0-9]{4}$",
    "y-M": r"^[0-9]{4}-[0-9]{1,2}$",
    "y": r"^[0-9]{4}$",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def if_else_null(cond, when_true, when_false) -> Column:
    """if/else whose result is NULL when the condition is NULL.

    SQL ``CASE WHEN`` treats a NULL condition as false; the analysis this
    library reproduces propagates it instead.
    """
    cond = _c(cond)
    return (F.when(cond.isNull(), F.lit(None))
            .when(cond, when_true)
            .otherwise(when_false))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns (both count as missing)."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def replace_all(col, pattern: str, replacement: str) -> Column:
    """Global regex replace on substrings."""
    return F.regexp_replace(_c(col), pattern, replacement)


def round_half_even(col, digits: int = 0) -> Column:
    return F.bround(_c(col), digits)


def safe_ratio(num, den) -> Column:
    """num / den as double; NULL (not an error) when den is 0."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def percent_label(col) -> Column:
    """0.56 -> '56%' (half-even to whole percent)."""
    return F.concat(F.bround(_c(col) * 100, 0).cast("long").cast("string"), F.lit("%"))


# Text made of letter/digit tokens split by single common separators; for it
# a character translation gives the same result as the general regex.
_SIMPLE_DATE_TEXT = r"^[0-9A-Za-z]+([-/. ][0-9A-Za-z]+)*$"


def normalise_date_text(col) -> Column:
    """Runs of separators to a single "-", none at the ends."""
    s = _c(col).cast("string")
    general = F.btrim(F.regexp_replace(s, "[^0-9A-Za-z]+", "-"), F.lit("-"))
    return F.when(s.rlike(_SIMPLE_DATE_TEXT), F.translate(s, "/. ", "---")).otherwise(general)


def parse_dates(col, orders: Sequence[str] = DEFAULT_DATE_ORDERS,
                normalised: bool = False) -> Column:
    """String to date by an ordered list of formats; unparseable -> NULL.

    Separators are normalised first so ``2020/01.05`` and ``2020-1-5`` match
    ``y-M-d``. Values without a four-digit year never parse, which keeps
    short strings such as ``12`` from becoming year 12. Pass
    ``normalised=True`` for text already run through ``normalise_date_text``
    (see ``parse_date_columns``, which computes it once per row).
    """
    norm = _c(col) if normalised else normalise_date_text(col)
    tries = []
    for p in orders:
        shape = _SHAPES.get(p)
        attempt = F.try_to_date(norm, p)
        tries.append(F.when(norm.rlike(shape), attempt) if shape else attempt)
    return F.when(norm.rlike(_YEAR_GUARD), F.coalesce(*tries))


def parse_date_columns(df: DataFrame, columns: dict[str, Column | str],
                       orders: Sequence[str] = DEFAULT_DATE_ORDERS) -> DataFrame:
    """Add/replace date columns parsed from text columns/expressions.

    The normalised text is projected first, so it is computed once per value
    rather than once per format tried.
    """
    tmp = {name: f"__norm_{i}" for i, name in enumerate(columns)}
    staged = df.withColumns({tmp[n]: normalise_date_text(src) for n, src in columns.items()})
    parsed = staged.withColumns(
        {n: parse_dates(F.col(tmp[n]), orders, normalised=True) for n in columns})
    return parsed.drop(*tmp.values())


def to_date_column(df: DataFrame, name: str,
                   orders: Sequence[str] = DEFAULT_DATE_ORDERS) -> Column:
    """Date view of a column of any type: strings are parsed, timestamps cast."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.col(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("date")
    return parse_dates(F.col(name), orders)
