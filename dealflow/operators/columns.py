"""Projections: add/replace, select by substring, drop, reorder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame

ColumnFn = Callable[[Column], Column]


def mutate(df: DataFrame, *steps: tuple[str, Column | Callable[[DataFrame], Column]]) -> DataFrame:
    """Add or replace columns in order; each step sees the ones before it.

    A single ``withColumns`` resolves an overwritten name to its *old* value;
    chaining keeps the sequential meaning. Catalyst collapses the chain into
    one projection, so this costs nothing at run time.
    """
    for name, expr in steps:
        df = df.withColumn(name, expr(df) if callable(expr) else expr)
    return df


def names_containing(df: DataFrame, patterns: str | Iterable[str]) -> list[str]:
    """Columns whose name contains any pattern, case-insensitive, in df order."""
    pats = [patterns] if isinstance(patterns, str) else list(patterns)
    pats = [p.lower() for p in pats]
    return [c for c in df.columns if any(p in c.lower() for p in pats)]


def across_contains(df: DataFrame, patterns: str | Iterable[str], fn: ColumnFn) -> DataFrame:
    """Apply ``fn`` to every column whose name contains one of ``patterns``."""
    hit = set(names_containing(df, patterns))
    return df.select(*[fn(df[c]).alias(c) if c in hit else df[c] for c in df.columns])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_first(df: DataFrame, *names: str) -> DataFrame:
    """Pinned columns first, every other column after in its current order."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*names, *rest)


def relocate(df: DataFrame, name: str, before: str | int | None = None,
             after: str | None = None) -> DataFrame:
    """Move one column before a column/position or after a column."""
    cols = [c for c in df.columns if c != name]
    if after is not None:
        pos = cols.index(after) + 1
    elif isinstance(before, int):
        pos = max(before - 1, 0)
    elif before is not None:
        pos = cols.index(before)
    else:
        pos = 0
    cols.insert(pos, name)
    return df.select(*cols)
