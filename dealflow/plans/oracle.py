"""DuckDB SQL for the correctness oracle, written independently of the Spark
code. Each query is a WITH chain over the pre-registered test tables.
"""

from __future__ import annotations

BASE_CTES = {
    "ship": """
  SELECT o.o_orderkey AS k, min(CAST(l.l_shipdate AS DATE)) AS d
  FROM orders o JOIN lineitem l
    ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate
  GROUP BY o.o_orderkey""",
    "opps": """
  SELECT o.o_orderkey AS id,
         c.c_name AS opportunity_owner,
         concat('Company ', CAST(o.o_custkey AS VARCHAR)) AS company,
         CASE o.o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'P' THEN 'Closed Lost'
           ELSE CASE o.o_orderpriority
             WHEN '1-URGENT' THEN 'NEW' WHEN '2-HIGH' THEN 'Pitch Arranged'
             WHEN '3-MEDIUM' THEN 'Pitch Took Place' WHEN '4-NOT SPECIFIED' THEN 'Contract Shipped'
             WHEN '5-LOW' THEN 'Contract Received' END END AS stage,
         CAST(o.o_orderdate AS DATE) AS created_date,
         s.d AS last_stage_change_date,
         CAST(floor(greatest(c.c_acctbal, 0)) AS INTEGER) AS employees,
         CASE WHEN o.o_orderstatus = 'F' THEN
           CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 35.0 WHEN 'MACHINERY' THEN 30.0 ELSE 33.0 END
         END::DOUBLE AS sold_price_per_registered_member
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN ship s ON s.k = o.o_orderkey""",
    "reps": """
  SELECT regexp_replace(CASE WHEN c_custkey % 50 = 0 THEN 'Former ' || c_name ELSE c_name END,
                        ' ', '_', 'g') AS sales_rep,
         CASE WHEN c_mktsegment = 'HOUSEHOLD'
              THEN CASE WHEN c_custkey % 2 = 0 THEN 'SMB' ELSE 'TEAM SMB' END
              ELSE c_mktsegment END AS team
  FROM customer""",
    "v1": """
  SELECT o.id, regexp_replace(o.opportunity_owner, ' ', '_', 'g') AS opportunity_owner,
         regexp_replace(r.team, 'TEAM SMB', 'SMB', 'g') AS team,
         regexp_replace(o.company, ' ', '_', 'g') AS company,
         o.stage, o.created_date, o.last_stage_change_date, o.employees,
         o.sold_price_per_registered_member
  FROM opps o LEFT JOIN reps r
    ON regexp_replace(o.opportunity_owner, ' ', '_', 'g') IS NOT DISTINCT FROM r.sales_rep""",
    "v2": """
  SELECT id, opportunity_owner, team, company, stage, created_date,
         CASE WHEN nd IS NULL THEN NULL WHEN nd THEN created_date ELSE last_stage_change_date END
           AS last_stage_change_date,
         employees, sold_price_per_registered_member,
         CASE WHEN nd IS NULL THEN NULL WHEN nd THEN TRUE ELSE FALSE END AS imputed_last_stage
  FROM (SELECT *, (stage = 'NEW' AND last_stage_change_date IS NULL) AS nd FROM v1)""",
    "med": """
  SELECT stage, quantile_cont(date_diff('day', created_date, last_stage_change_date), 0.5)
           AS median_days_to_stage
  FROM v2 WHERE last_stage_change_date IS NOT NULL GROUP BY stage""",
    "imp": """
  SELECT x.id, x.opportunity_owner, x.team, x.company, x.stage, x.created_date,
         CASE WHEN x.nd IS NULL THEN NULL
              WHEN x.nd THEN x.created_date + CAST(round_even(m.median_days_to_stage, 0) AS INTEGER)
              ELSE x.last_stage_change_date END AS last_stage_change_date,
         x.employees, x.sold_price_per_registered_member,
         CASE WHEN x.nd IS NULL THEN NULL WHEN x.nd THEN TRUE ELSE x.imputed_last_stage END
           AS imputed_last_stage
  FROM (SELECT *, (last_stage_change_date IS NULL AND stage <> 'NEW') AS nd FROM v2) x
  LEFT JOIN med m ON x.stage IS NOT DISTINCT FROM m.stage""",
    "closed": """
  SELECT *, CASE WHEN stage = 'Closed Won' THEN 'Won' WHEN stage = 'Closed Lost' THEN 'Lost'
                 ELSE 'Open' END AS deal_outcome,
         CAST(date_diff('day', created_date, last_stage_change_date) AS DOUBLE) AS sales_cycle_days
  FROM imp""",
}

_ORDER = ["ship", "opps", "reps", "v1", "v2", "med", "imp", "closed"]


def with_base(body: str, upto: str = "closed", extra: dict[str, str] | None = None) -> str:
    """``WITH`` the base chain up to ``upto`` (plus extra CTEs), then ``body``."""
    names = _ORDER[: _ORDER.index(upto) + 1]
    parts = [f"{n} AS ({BASE_CTES[n]}\n)" for n in names]
    for n, sql in (extra or {}).items():
        parts.append(f"{n} AS ({sql}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + body
