"""Column-level functions (names, scalars, dates, conditionals)."""

from dealflow.functions.names import clean_names, snake_name
from dealflow.functions.scalars import (
    DEFAULT_DATE_ORDERS,
    FULL_DATE_ORDERS,
    if_else_null,
    is_missing,
    parse_dates,
    percent_label,
    replace_all,
    round_half_even,
    safe_ratio,
    to_date_column,
)

__all__ = [
    "clean_names", "snake_name", "DEFAULT_DATE_ORDERS", "FULL_DATE_ORDERS",
    "if_else_null", "is_missing", "parse_dates", "percent_label", "replace_all",
    "round_half_even", "safe_ratio", "to_date_column",
]
