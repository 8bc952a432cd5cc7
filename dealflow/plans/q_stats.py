"""Registered queries: contingency, chi-square, Monte-Carlo tests, Spearman."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealflow.operators import metrics as m
from dealflow.operators import stats as st
from dealflow.operators.aggregates import pivot_by_data
from dealflow.operators.permutation import REPLICATES, permutation_test
from dealflow.plans.catalog import r6, register, with_base
from dealflow.plans.flow import analysis

# The seed is ours: the original sets none.
SEED = 20240101

_LONG_SQL = """
SELECT t.team, o.deal_outcome, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT team FROM closed WHERE deal_outcome IN ('Won', 'Lost')) t
JOIN (SELECT DISTINCT deal_outcome FROM closed WHERE deal_outcome IN ('Won', 'Lost')) o ON TRUE
LEFT JOIN (SELECT team, deal_outcome, count(*) AS n FROM closed
           WHERE deal_outcome IN ('Won', 'Lost') GROUP BY team, deal_outcome) c
  ON c.team IS NOT DISTINCT FROM t.team AND c.deal_outcome = o.deal_outcome"""


_CHI_SQL = f"""
SELECT sum((n - e) * (n - e) / e) AS statistic,
       CAST((count(DISTINCT coalesce(team, '<null>')) - 1) * (count(DISTINCT deal_outcome) - 1) AS BIGINT) AS df
FROM (SELECT n, sum(n) OVER (PARTITION BY team)::DOUBLE * sum(n) OVER (PARTITION BY deal_outcome)
                / sum(n) OVER () AS e, team, deal_outcome
      FROM ({_LONG_SQL}))"""


def _long(spark, sf):
    return st.contingency(analysis(spark, sf).closed_outcomes, "team", "deal_outcome", [m.LOST, m.WON])


@register("contingency_long", with_base(_LONG_SQL))
def contingency_long(spark, sf):
    return _long(spark, sf)


@register("contingency_by_data", with_base("""
SELECT team, count(*) FILTER (deal_outcome = 'Won') AS n_Won, count(*) FILTER (deal_outcome = 'Lost') AS n_Lost,
       (SELECT string_agg(o, ',' ORDER BY f) FROM (
          SELECT deal_outcome AS o, min(id) AS f FROM closed WHERE deal_outcome <> 'Open' GROUP BY deal_outcome)) AS column_order
FROM closed WHERE deal_outcome <> 'Open' GROUP BY team"""))
def contingency_by_data(spark, sf):
    """The wide contingency table with the outcomes found in the data as columns,
    in the order of their first deal."""
    counted = analysis(spark, sf).closed_outcomes.groupBy("team", "deal_outcome").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    wide, values = pivot_by_data(counted, "team", "deal_outcome", "n", "first_id", prefix="n_")
    names = [f"n_{v}" for v in values]
    return wide.fillna(0, names).select("team", *names, F.lit(",".join(values)).alias("column_order"))


@register("chi_square", with_base(f"SELECT round(statistic, 6) AS statistic, df FROM ({_CHI_SQL})"))
def chi_square(spark, sf):
    return st.chi_square(_long(spark, sf), "team", "deal_outcome").select(r6("statistic"), "df")


# Labels dealt by the keyed hash of (seed, pair of replicates, id); the table as
# it is counts as replicate -1.
def _dealt(replicates: int) -> dict[str, str]:
    return {
        "deals": "SELECT id, team, deal_outcome AS o FROM closed WHERE deal_outcome IN ('Won', 'Lost')",
        "keyed": f"""
  SELECT r, team, row_number() OVER (PARTITION BY r ORDER BY
           substr(md5(concat_ws(':', {SEED}, r // 2, id)), 1 + 16 * (r % 2), 16), CAST(id AS VARCHAR)) AS k
  FROM deals, range({replicates}) AS t(r)""",
        "cells": """
  SELECT r, team, o, count(*) AS x FROM (
    SELECT r, team, CASE WHEN k <= (SELECT count(*) FROM deals WHERE o = 'Lost') THEN 'Lost' ELSE 'Won' END AS o
    FROM keyed UNION ALL SELECT -1, team, o FROM deals) GROUP BY r, team, o""",
        "sums": """
  SELECT r, sum(lgamma(x + 1)) AS f, sum(x * x / e) - sum(x) AS c
  FROM cells JOIN (
    SELECT t.team AS team2, t.n * l.n / (SELECT count(*) FROM deals) AS e, l.o AS o2
    FROM (SELECT team, count(*)::DOUBLE AS n FROM deals GROUP BY team) t,
         (SELECT o, count(*)::DOUBLE AS n FROM deals GROUP BY o) l)
    ON team IS NOT DISTINCT FROM team2 AND o = o2
  GROUP BY r"""}


def _mc_sql(column: str, slack: str, replicates: int) -> str:
    return with_base(f"""
SELECT round({column}0, 6) AS statistic, df, CAST({replicates} AS BIGINT) AS replicates, n_extreme,
       round((1 + n_extreme) / {replicates + 1}.0::DOUBLE, 6) AS p_value
FROM (SELECT max(o.{column}) AS {column}0, count(*) FILTER (s.{column} >= o.{column} - {slack}) AS n_extreme
      FROM sums s, sums o WHERE s.r >= 0 AND o.r = -1),
     (SELECT CAST((count(DISTINCT coalesce(team, '<null>')) - 1) * (count(DISTINCT o) - 1) AS BIGINT) AS df FROM deals)""",
                     extra=_dealt(replicates))


def _permuted(spark, sf, kind):
    closed = analysis(spark, sf).closed_outcomes.where(F.col("deal_outcome").isin(m.LOST, m.WON))
    out = permutation_test(closed, "team", "deal_outcome", kind, seed=SEED)
    return out.select(r6("statistic"), "df", "replicates", "n_extreme", r6("p_value"))


@register("chi_square_mc", _mc_sql("c", "1e-9 * greatest(1, o.c)", REPLICATES["chisq"]))
def chi_square_mc(spark, sf):
    return _permuted(spark, sf, "chisq")


@register("fisher_mc", _mc_sql("f", "(1e-7 + 1e-14 * o.f)", REPLICATES["fisher"]))
def fisher_mc(spark, sf):
    """The simulated Fisher test; its statistic is the sum of log factorials."""
    return _permuted(spark, sf, "fisher")


@register("fisher_team_against_rest", with_base(f"""
SELECT 'exact' AS method, round(sum(CASE WHEN w <= obs + 1e-7 THEN exp(w) ELSE 0 END) / sum(exp(w)), 6) AS p_value
FROM (SELECT lw - max(lw) OVER () AS w, max(CASE WHEN x = a THEN lw END) OVER () - max(lw) OVER () AS obs
      FROM (SELECT x, a, -(lgamma(x + 1) + lgamma(g - x + 1) + lgamma(k - x + 1) + lgamma(b - k + x + 1)) AS lw
            FROM (SELECT *, unnest(range(greatest(0, k - b), least(k, g) + 1)) AS x
                  FROM (SELECT sum(n) FILTER (team = 'SMB' AND deal_outcome = 'Lost')::BIGINT AS a,
                               sum(n) FILTER (deal_outcome = 'Lost')::BIGINT AS g,
                               sum(n) FILTER (deal_outcome = 'Won')::BIGINT AS b,
                               sum(n) FILTER (team = 'SMB')::BIGINT AS k FROM ({_LONG_SQL})))))"""))
def fisher_team_against_rest(spark, sf):
    """The highlighted team against all others: an exact 2 x 2 test."""
    two = analysis(spark, sf).closed_outcomes.withColumn("team", F.coalesce(F.col("team") == "SMB", F.lit(False)))
    long = st.contingency(two, "team", "deal_outcome", [m.LOST, m.WON])
    return st.fisher_mc(spark, long, "team", "deal_outcome", seed=SEED).select("method", r6("p_value"))


@register("spearman_size_cycle", with_base("""
SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n_pairs
FROM (SELECT (rank() OVER (ORDER BY employees) + count(*) OVER (PARTITION BY employees) - 1
              + rank() OVER (ORDER BY employees)) / 2.0 AS rx,
             (rank() OVER (ORDER BY sales_cycle_days) + count(*) OVER (PARTITION BY sales_cycle_days) - 1
              + rank() OVER (ORDER BY sales_cycle_days)) / 2.0 AS ry
      FROM closed WHERE employees IS NOT NULL AND sales_cycle_days IS NOT NULL)"""))
def spearman_size_cycle(spark, sf):
    out = st.spearman(analysis(spark, sf).closed, "employees", "sales_cycle_days")
    return out.select(r6("rho"), "n_pairs")
