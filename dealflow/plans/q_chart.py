"""Registered queries: histogram, win-rate bars, box-plot statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealflow.operators import chartdata as cd
from dealflow.plans.catalog import r6, register, with_base
from dealflow.plans.q_core import _TEAM_CONVERSION_SQL, _team_conversion
from dealflow.plans.flow import analysis

# Histogram bin count and the employee outlier cut.
BINS = 100
EMPLOYEE_CUT = 7000


def _histogram_sql(values: str) -> str:
    return with_base(_HISTOGRAM_SQL, "v2", {"f": values, **_HISTOGRAM_CTES})


_HISTOGRAM_SQL = f"""
SELECT b.bin, round(w.origin + (b.bin - 1) * w.width, 6) AS xmin,
       round(w.origin + (b.bin - 1) * w.width + w.width, 6) AS xmax,
       round(w.origin + (b.bin - 1) * w.width + w.width / 2, 6) AS x,
       coalesce(c.count, 0) AS count
FROM (SELECT range AS bin FROM range(1, {BINS + 1})) b
CROSS JOIN w
LEFT JOIN c ON c.bin = b.bin"""
_HISTOGRAM_CTES = {
    "w": f"SELECT (max(x) - min(x)) / {BINS - 1} AS width, "
         f"(max(x) - min(x)) / {BINS - 1} / 2 + floor((min(x) - (max(x) - min(x)) / {BINS - 1} / 2) "
         f"/ ((max(x) - min(x)) / {BINS - 1})) * ((max(x) - min(x)) / {BINS - 1}) AS origin FROM f",
    "c": f"SELECT CAST(least(greatest(ceil((f.x - w.origin) / w.width - 1e-8), 1), {BINS}) AS BIGINT)"
         f" AS bin, count(*) AS count FROM f CROSS JOIN w GROUP BY 1",
}


@register("employee_histogram", _histogram_sql(
    f"SELECT CAST(employees AS DOUBLE) AS x FROM v2 WHERE employees < {EMPLOYEE_CUT}"))
def employee_histogram(spark, sf):
    v2 = analysis(spark, sf).v2
    h = cd.histogram(v2.where(F.col("employees") < EMPLOYEE_CUT), "employees", BINS)
    return h.select("bin", r6("xmin"), r6("xmax"), r6("x"), "count")


@register("cycle_start_histogram", _histogram_sql(
    "SELECT CAST(date_diff('day', DATE '1970-01-01', created_date) AS DOUBLE) AS x FROM v2"))
def cycle_start_histogram(spark, sf):
    """Creation days since 1970: values that start far from zero."""
    days = analysis(spark, sf).v2.select(F.unix_date("created_date").alias("day"))
    return cd.histogram(days, "day", BINS).select("bin", r6("xmin"), r6("xmax"), r6("x"), "count")


@register("chart_win_rate_bars", with_base(f"""
SELECT team, conversion_rate,
       row_number() OVER (ORDER BY conversion_rate ASC NULLS FIRST, team ASC NULLS FIRST) AS axis_pos,
       CAST(CAST(round_even(conversion_rate * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS label,
       coalesce(team = 'SMB', FALSE) AS highlight,
       CASE WHEN coalesce(team = 'SMB', FALSE) THEN '{cd.HIGHLIGHT_FILL}' ELSE '{cd.BASE_FILL}' END AS fill
FROM ({_TEAM_CONVERSION_SQL})"""))
def chart_win_rate_bars(spark, sf):
    return cd.win_rate_bars(_team_conversion(spark, sf))


_BOX_CTES = {
    "bx": "SELECT team, deal_outcome, sales_cycle_days AS v FROM closed "
          "WHERE deal_outcome IN ('Won', 'Lost') AND sales_cycle_days IS NOT NULL",
    "bq": "SELECT team, deal_outcome, quantile_cont(v, 0.25) AS lower, "
          "quantile_cont(v, 0.5) AS middle, quantile_cont(v, 0.75) AS upper "
          "FROM bx GROUP BY team, deal_outcome",
    "bj": "SELECT bx.team, bx.deal_outcome, bx.v, bq.lower, bq.middle, bq.upper, "
          "bq.lower - 1.5 * (bq.upper - bq.lower) AS lo, bq.upper + 1.5 * (bq.upper - bq.lower) AS hi "
          "FROM bx JOIN bq ON bx.team IS NOT DISTINCT FROM bq.team "
          "AND bx.deal_outcome = bq.deal_outcome",
}


@register("cycle_boxplot", with_base("""
SELECT team, deal_outcome, count(*) AS n,
       round(least(min(CASE WHEN v >= lo AND v <= hi THEN v END), min(lower)), 6) AS ymin,
       round(min(lower), 6) AS lower, round(min(middle), 6) AS middle, round(min(upper), 6) AS upper,
       round(greatest(max(CASE WHEN v >= lo AND v <= hi THEN v END), max(upper)), 6) AS ymax,
       count(CASE WHEN NOT (v >= lo AND v <= hi) THEN 1 END) AS n_outliers
FROM bj GROUP BY team, deal_outcome""", "closed", _BOX_CTES))
def cycle_boxplot(spark, sf):
    closed = analysis(spark, sf).closed_deals
    b = cd.boxplot_stats(closed, ["team", "deal_outcome"], "sales_cycle_days")
    return b.select("team", "deal_outcome", "n", r6("ymin"), r6("lower"), r6("middle"),
                    r6("upper"), r6("ymax"), "n_outliers")


@register("cycle_outliers", with_base("""
SELECT team, deal_outcome, v AS sales_cycle_days FROM bj WHERE v < lo OR v > hi""",
                                      "closed", _BOX_CTES))
def cycle_outliers(spark, sf):
    closed = analysis(spark, sf).closed_deals.select(
        "team", "deal_outcome", "sales_cycle_days")
    return cd.boxplot_outliers(closed, ["team", "deal_outcome"], "sales_cycle_days")
