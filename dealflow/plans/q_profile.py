"""Registered queries: typed column profiles of the cleaned frame."""

from __future__ import annotations


from pyspark.sql import functions as F

from dealflow.operators import profile as pr
from dealflow.plans.catalog import r6, register, with_base
from dealflow.plans.flow import analysis

NUMERIC = ["id", "employees", "sold_price_per_registered_member"]
CATEGORICAL = ["opportunity_owner", "team", "company", "stage"]
DATES = ["created_date", "last_stage_change_date"]


def _miss(c):
    return (f"count(CASE WHEN {c} IS NULL THEN 1 END) AS n_missing, "
            f"round(1 - count(CASE WHEN {c} IS NULL THEN 1 END) / count(*), 6) AS complete_rate")


def _numeric_sql() -> str:
    parts = []
    for c in NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        qs = ", ".join(f"round(quantile_cont({x}, {p}), 6) AS {n}"
                       for p, n in zip(pr.QUANTILE_PROBS, pr.QUANTILE_NAMES))
        parts.append(f"SELECT '{c}' AS skim_variable, {_miss(c)}, round(avg({x}), 6) AS mean, "
                     f"round(stddev_samp({x}), 6) AS sd, {qs} FROM v2")
    return with_base("\nUNION ALL\n".join(parts), "v2")


def _categorical_sql() -> str:
    parts = []
    for c in CATEGORICAL:
        top = (f"(SELECT string_agg(v || ': ' || CAST(n AS VARCHAR), ', ' "
               f"ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM v2 "
               f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 4))")
        parts.append(f"SELECT '{c}' AS skim_variable, {_miss(c)}, "
                     f"count(DISTINCT {c}) AS n_unique, {top} AS top_counts FROM v2")
    return with_base("\nUNION ALL\n".join(parts), "v2")


def _date_sql() -> str:
    parts = []
    for c in DATES:
        med = (f"CAST(DATE '1970-01-01' + CAST(floor(quantile_cont("
               f"date_diff('day', DATE '1970-01-01', {c}), 0.5)) AS INTEGER) AS DATE)")
        parts.append(f"SELECT '{c}' AS skim_variable, {_miss(c)}, min({c}) AS min, "
                     f"max({c}) AS max, count(DISTINCT {c}) AS n_unique, {med} AS median FROM v2")
    return with_base("\nUNION ALL\n".join(parts), "v2")


_BOOL_SQL = with_base(f"""
SELECT 'imputed_last_stage' AS skim_variable, {_miss('imputed_last_stage')},
       round(avg(CAST(imputed_last_stage AS DOUBLE)), 6) AS mean,
       count(CASE WHEN imputed_last_stage THEN 1 END) AS n_true,
       count(CASE WHEN NOT imputed_last_stage THEN 1 END) AS n_false
FROM v2""", "v2")


@register("profile_numeric", _numeric_sql())
def profile_numeric(spark, sf):
    t = pr.profile_numeric(analysis(spark, sf).v2, NUMERIC)
    return t.select("skim_variable", "n_missing", r6("complete_rate"), r6("mean"), r6("sd"),
                    *[r6(n) for n in pr.QUANTILE_NAMES])


@register("profile_categorical", _categorical_sql())
def profile_categorical(spark, sf):
    t = pr.profile_categorical(analysis(spark, sf).v2, CATEGORICAL)
    top = F.array_join(F.transform("top_counts", lambda s: F.concat(s["value"], F.lit(": "), s["n"])), ", ")
    return t.select("skim_variable", "n_missing", r6("complete_rate"), "n_unique", top.alias("top_counts"))


@register("profile_date", _date_sql())
def profile_date(spark, sf):
    t = pr.profile_date(analysis(spark, sf).v2, DATES)
    return t.select("skim_variable", "n_missing", r6("complete_rate"), "min", "max",
                    "n_unique", "median")


@register("profile_boolean", _BOOL_SQL)
def profile_boolean(spark, sf):
    t = pr.profile_boolean(analysis(spark, sf).v2, ["imputed_last_stage"])
    return t.select("skim_variable", "n_missing", r6("complete_rate"), r6("mean"),
                    "n_true", "n_false")




def _skim_sql() -> str:
    kinds = [("numeric", c) for c in NUMERIC] + [("categorical", c) for c in CATEGORICAL]
    kinds += [("date", c) for c in DATES] + [("boolean", "imputed_last_stage")]
    return with_base("\nUNION ALL\n".join(
        f"SELECT '{k}' AS kind, '{c}' AS skim_variable, {_miss(c)} FROM v2" for k, c in kinds), "v2")


@register("skim", _skim_sql())
def skim(spark, sf):
    """The one-call profile: every column under its type family."""
    out = None
    for kind, frame in pr.skim(analysis(spark, sf).v2).items():
        part = frame.select(F.lit(kind).alias("kind"), "skim_variable", "n_missing", r6("complete_rate"))
        out = part if out is None else out.unionByName(part)
    return out
