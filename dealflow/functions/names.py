"""Column-name normalisation (metadata only, no Spark job)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame

# Symbol words used when names are cleaned.
SYMBOL_WORDS = {"%": "percent", "#": "number"}
DROPPED_CHARS = ("'", '"')


def snake_name(name: str) -> str:
    """One name to lower snake_case, ASCII only, never empty, no leading digit."""
    s = str(name)
    for ch in DROPPED_CHARS:
        s = s.replace(ch, "")
    for sym, word in SYMBOL_WORDS.items():
        s = s.replace(sym, f"_{word}_")
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def unique_names(names: list[str]) -> list[str]:
    """Suffix repeats with _2, _3, ... in order of appearance."""
    seen: dict[str, int] = {}
    taken = set(names)
    out = []
    for n in names:
        if n not in seen:
            seen[n] = 1
            out.append(n)
            continue
        k = seen[n] + 1
        while f"{n}_{k}" in taken:
            k += 1
        seen[n] = k
        taken.add(f"{n}_{k}")
        out.append(f"{n}_{k}")
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to unique snake_case."""
    return df.toDF(*unique_names([snake_name(c) for c in df.columns]))
