"""Queries for sources, projections, filters, joins, metrics and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealflow.functions.names import clean_names
from dealflow.functions.scalars import (FULL_DATE_ORDERS, if_else_null, parse_date_columns,
                                        replace_all)
from dealflow.operators import aggregates as agg
from dealflow.operators import columns as cols
from dealflow.operators import filters as flt
from dealflow.operators import metrics as m
from dealflow.operators.joins import attach_group_stat
from dealflow.operators.ordering import row_id
from dealflow.plans.catalog import r6, register, with_base
from dealflow.plans.flow import analysis
from dealflow.session import shared_path
from dealflow.sources import io, testdata

V1_COLS = ["id", "opportunity_owner", "team", "company", "stage", "created_date",
           "last_stage_change_date", "employees", "sold_price_per_registered_member"]


# ---------------------------------------------------------------- sources
@register("scan_opportunities", with_base("SELECT * FROM opps", "opps"))
def scan_opportunities(spark, sf):
    return testdata.opportunities(spark, sf)


@register("scan_rep_team", """
SELECT CASE WHEN c_custkey % 50 = 0 THEN 'Former ' || c_name ELSE c_name END AS sales_rep,
       CASE WHEN c_mktsegment = 'HOUSEHOLD'
            THEN CASE WHEN c_custkey % 2 = 0 THEN 'SMB' ELSE 'TEAM SMB' END
            ELSE c_mktsegment END AS team
FROM customer""")
def scan_rep_team(spark, sf):
    return testdata.sales_rep_team(spark, sf)


@register("clean_names", """
SELECT p_partkey AS part_key, p_name AS part_name, p_retailprice AS retail_price_percent,
       p_size AS x2nd_size, p_brand AS a_b, p_type AS a_b_2, p_partkey AS number_of_parts
FROM part""")
def clean_names_q(spark, sf):
    p = testdata.table(spark, sf, "part")
    messy = p.select(F.col("p_partkey").alias("Part Key"), F.col("p_name").alias("partName"),
                     F.col("p_retailprice").alias("Retail Price (%)"),
                     F.col("p_size").alias("2nd Size"), F.col("p_brand").alias("A b"),
                     F.col("p_type").alias("a_B"), F.col("p_partkey").alias("# of parts"))
    return clean_names(messy)


@register("remove_empty", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'""")
def remove_empty_q(spark, sf):
    c = testdata.table(spark, sf, "customer")
    keep = F.col("c_mktsegment") != "AUTOMOBILE"
    holey = c.select(F.when(keep, F.col("c_custkey")).alias("c_custkey"),
                     F.when(keep, F.col("c_name")).alias("c_name"),
                     F.lit(None).cast("string").alias("c_comment"),
                     F.when(keep, F.col("c_acctbal")).alias("c_acctbal"))
    return io.remove_empty(holey)


_TEAM_CONVERSION_SQL = """
SELECT CASE WHEN conversion_rate IS NULL THEN NULL
            ELSE dense_rank() OVER (ORDER BY conversion_rate DESC NULLS LAST) END AS team_rank,
       team, won, lost, conversion_rate, won + lost AS team_volume
FROM (SELECT team,
             count(CASE WHEN deal_outcome = 'Won' THEN 1 END) AS won,
             count(CASE WHEN deal_outcome = 'Lost' THEN 1 END) AS lost,
             round_even(count(CASE WHEN deal_outcome = 'Won' THEN 1 END) / count(*)::DOUBLE, 2)
               AS conversion_rate
      FROM closed WHERE deal_outcome IN ('Won', 'Lost') GROUP BY team)"""


def _team_conversion(spark, sf, a=None):
    t = m.team_conversion((a or analysis(spark, sf)).closed_outcomes)
    return t.withColumn("team_rank", F.col("team_rank").cast("long"))


@register("preview_head", with_base("SELECT * FROM v1 ORDER BY id LIMIT 6", "v1"))
def preview_head_q(spark, sf):
    return io.preview_head(analysis(spark, sf).v1, "id", 6)


# ---------------------------------------------------------------- projections
@register("add_columns", with_base("""
SELECT id, CAST(date_diff('day', created_date, last_stage_change_date) AS BIGINT) AS cycle,
       CAST(floor(date_diff('day', created_date, last_stage_change_date) / 7) AS BIGINT) AS cycle_weeks,
       employees + 1 AS employees, (employees + 1) * 2 AS employees_doubled
FROM v1""", "v1"))
def add_columns_q(spark, sf):
    v1 = analysis(spark, sf).v1
    out = cols.mutate(
        v1,
        ("cycle", F.datediff("last_stage_change_date", "created_date").cast("long")),
        ("cycle_weeks", F.floor(F.col("cycle") / 7).cast("long")),
        ("employees", F.col("employees") + 1),
        ("employees_doubled", F.col("employees") * 2),
    )
    return out.select("id", "cycle", "cycle_weeks", "employees", "employees_doubled")


@register("across_contains", with_base("""
SELECT id, upper(opportunity_owner) AS opportunity_owner, upper(company) AS company, stage
FROM v1""", "v1"))
def across_contains_q(spark, sf):
    v1 = analysis(spark, sf).v1
    out = cols.across_contains(v1, ["OWNER", "company"], F.upper)
    return out.select("id", "opportunity_owner", "company", "stage")


@register("drop_columns", with_base("SELECT * EXCLUDE (company, employees) FROM v1", "v1"))
def drop_columns_q(spark, sf):
    return cols.drop_columns(analysis(spark, sf).v1, "company", "employees")


@register("reorder_columns", with_base(
    "SELECT stage, team, opportunity_owner, company, id, created_date, last_stage_change_date, "
    "employees, sold_price_per_registered_member FROM v1", "v1"))
def reorder_columns_q(spark, sf):
    v1 = analysis(spark, sf).v1
    return cols.relocate(cols.select_first(v1, "stage", "team"), "id", after="company")


@register("row_id", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS id, l_orderkey, l_linenumber
FROM lineitem""")
def row_id_q(spark, sf):
    li = testdata.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return row_id(li, ["l_orderkey", "l_linenumber"], "id")


# ---------------------------------------------------------------- filters
@register("filter_missing_dates",
          with_base("SELECT * FROM v1 WHERE last_stage_change_date IS NULL", "v1"))
def filter_missing_dates(spark, sf):
    return flt.where_missing(analysis(spark, sf).v1, "last_stage_change_date")


@register("filter_closed", with_base("SELECT * FROM closed WHERE deal_outcome IN ('Won', 'Lost')"))
def filter_closed(spark, sf):
    return analysis(spark, sf).closed_deals


@register("filter_lost", with_base("SELECT * FROM closed WHERE deal_outcome = 'Lost'"))
def filter_lost(spark, sf):
    return flt.where_equal(analysis(spark, sf).closed_deals, "deal_outcome", m.LOST)


@register("filter_won_priced", with_base(
    "SELECT * FROM closed WHERE deal_outcome = 'Won' "
    "AND sold_price_per_registered_member IS NOT NULL"))
def filter_won_priced(spark, sf):
    c = analysis(spark, sf).closed_deals
    return c.where((F.col("deal_outcome") == m.WON)
                   & ~F.col("sold_price_per_registered_member").isNull())


@register("filter_outliers", with_base("SELECT * FROM v2 WHERE employees < 7000", "v2"))
def filter_outliers(spark, sf):
    return flt.where_below(analysis(spark, sf).v2, "employees", 7000)


@register("remaining_missing_all_missing_stage", with_base("""
SELECT id, stage, TRUE AS imputed_last_stage FROM v2 WHERE stage = 'Pitch Arranged'""", "v2"))
def remaining_missing_all_missing_stage(spark, sf):
    """What the quality gate finds when a stage has no date to take a median from."""
    from dealflow.operators.impute import group_median_lag, impute_by_group_median
    v2 = analysis(spark, sf).v2
    holed = v2.withColumn("last_stage_change_date", F.when(
        ~F.col("stage").eqNullSafe("Pitch Arranged"), F.col("last_stage_change_date")))
    imputed = impute_by_group_median(holed, group_median_lag(holed))
    return flt.where_missing(imputed, "last_stage_change_date").select("id", "stage", "imputed_last_stage")


@register("remaining_missing",
          with_base("SELECT * FROM imp WHERE last_stage_change_date IS NULL", "imp"))
def remaining_missing(spark, sf):
    return flt.where_missing(analysis(spark, sf).imputed, "last_stage_change_date")


# ---------------------------------------------------------------- joins
@register("join_rep_team", with_base("""
SELECT o.id, regexp_replace(o.opportunity_owner, ' ', '_', 'g') AS opportunity_owner, r.team,
       regexp_replace(o.company, ' ', '_', 'g') AS company, o.stage, o.created_date,
       o.last_stage_change_date, o.employees, o.sold_price_per_registered_member
FROM opps o LEFT JOIN reps r
  ON regexp_replace(o.opportunity_owner, ' ', '_', 'g') IS NOT DISTINCT FROM r.sales_rep""", "reps"))
def join_rep_team(spark, sf):
    return analysis(spark, sf).joined


@register("join_stage_median", with_base("""
SELECT v2.*, m.median_days_to_stage
FROM v2 LEFT JOIN med m ON v2.stage IS NOT DISTINCT FROM m.stage""", "med"))
def join_stage_median(spark, sf):
    a = analysis(spark, sf)
    return attach_group_stat(a.v2, a.stage_medians, "stage")


# ---------------------------------------------------------------- aggregates
@register("missing_by_stage", with_base(
    "SELECT stage, count(*) AS count FROM v1 WHERE last_stage_change_date IS NULL "
    "GROUP BY stage", "v1"))
def missing_by_stage(spark, sf):
    return m.missing_by_stage(analysis(spark, sf).v1)


_COUNT_TEAM_OUTCOME = ("SELECT team, deal_outcome, count(*) AS n FROM closed "
                       "WHERE deal_outcome IN ('Won', 'Lost') GROUP BY team, deal_outcome")


@register("count_team_outcome", with_base(_COUNT_TEAM_OUTCOME))
def count_team_outcome(spark, sf):
    return agg.count_by(analysis(spark, sf).closed_outcomes, "team", "deal_outcome")


@register("overall_conversion", with_base("""
SELECT total_won, total_lost,
       CASE WHEN total_won + total_lost = 0 THEN NULL
            ELSE round_even(total_won / (total_won + total_lost)::DOUBLE, 2) END AS conversion_rate
FROM (SELECT count(CASE WHEN deal_outcome = 'Won' THEN 1 END) AS total_won,
             count(CASE WHEN deal_outcome = 'Lost' THEN 1 END) AS total_lost
      FROM closed WHERE deal_outcome IN ('Won', 'Lost'))"""))
def overall_conversion(spark, sf):
    return m.overall_conversion(analysis(spark, sf).closed_outcomes)


@register("imputation_summary", with_base("""
SELECT imputed_last_stage, count(*) AS total_deals,
       count(CASE WHEN last_stage_change_date IS NULL THEN 1 END) AS missing_dates_remaining
FROM imp GROUP BY imputed_last_stage""", "imp"))
def imputation_summary(spark, sf):
    from dealflow.operators.impute import imputation_summary as summ
    return summ(analysis(spark, sf).imputed)


def _null_profile_sql() -> str:
    parts = []
    for c in V1_COLS:
        cond = f"{c} IS NULL"
        if c == "sold_price_per_registered_member":
            cond = f"({c} IS NULL OR isnan({c}))"
        parts.append(f"SELECT '{c}' AS \"column\", count(CASE WHEN {cond} THEN 1 END) AS n_missing FROM v1")
    return with_base("\nUNION ALL\n".join(parts), "v1")


@register("null_profile", _null_profile_sql())
def null_profile(spark, sf):
    return agg.null_profile(analysis(spark, sf).v1)


@register("avg_cycle_by_outcome", with_base("""
SELECT deal_outcome, round(avg(sales_cycle_days), 6) AS avg_cycle_days,
       round(quantile_cont(sales_cycle_days, 0.5), 6) AS median_cycle_days,
       round(stddev_samp(sales_cycle_days), 6) AS sd_cycle_days
FROM closed WHERE deal_outcome IN ('Won', 'Lost') GROUP BY deal_outcome"""))
def avg_cycle_by_outcome(spark, sf):
    t = m.avg_cycle_by_outcome(analysis(spark, sf).closed_deals)
    return t.select("deal_outcome", r6("avg_cycle_days"), r6("median_cycle_days"),
                    r6("sd_cycle_days"))


@register("stage_median_days", with_base("SELECT * FROM med", "med"))
def stage_median_days(spark, sf):
    return analysis(spark, sf).stage_medians


@register("team_conversion", with_base(_TEAM_CONVERSION_SQL))
def team_conversion(spark, sf):
    return _team_conversion(spark, sf)


@register("won_revenue_by_team", with_base("""
SELECT team, round(avg_sold_price, 6) AS avg_sold_price,
       round(median_sold_price, 6) AS median_sold_price, won_deals_count,
       round(round_even(avg_sold_price, 2) * won_deals_count, 6) AS total_revenue
FROM (SELECT team, avg(sold_price_per_registered_member) AS avg_sold_price,
             quantile_cont(sold_price_per_registered_member, 0.5) AS median_sold_price,
             count(*) AS won_deals_count
      FROM closed WHERE deal_outcome = 'Won' AND sold_price_per_registered_member IS NOT NULL
      GROUP BY team)"""))
def won_revenue_by_team(spark, sf):
    t = m.won_revenue_by_team(analysis(spark, sf).closed_outcomes)
    return t.select("team", r6("avg_sold_price"), r6("median_sold_price"), "won_deals_count",
                    r6("total_revenue"))


@register("price_by_stage", with_base(
    "SELECT stage, sold_price_per_registered_member, count(*) AS count FROM v2 "
    "GROUP BY stage, sold_price_per_registered_member", "v2"))
def price_by_stage(spark, sf):
    return m.price_by_stage(analysis(spark, sf).v2)


@register("contingency_wide", with_base(f"""
SELECT team, max(CASE WHEN deal_outcome = 'Lost' THEN n END) AS "Lost",
       max(CASE WHEN deal_outcome = 'Won' THEN n END) AS "Won"
FROM ({_COUNT_TEAM_OUTCOME}) GROUP BY team"""))
def contingency_wide(spark, sf):
    long = agg.count_by(analysis(spark, sf).closed_outcomes, "team", "deal_outcome")
    return agg.pivot_wider(long, "team", "deal_outcome", "n", [m.LOST, m.WON])


@register("team_cycle_medians", with_base("""
SELECT team,
       quantile_cont(CASE WHEN deal_outcome = 'Lost' THEN sales_cycle_days END, 0.5) AS "cycle_Lost",
       quantile_cont(CASE WHEN deal_outcome = 'Won' THEN sales_cycle_days END, 0.5) AS "cycle_Won"
FROM closed WHERE deal_outcome IN ('Won', 'Lost') GROUP BY team"""))
def team_cycle_medians(spark, sf):
    return m.team_cycle_medians(analysis(spark, sf).closed_deals)


@register("lost_stage_share", with_base("""
SELECT stage, n, round(n / sum(n) OVER () * 100, 6) AS percent
FROM (SELECT stage, count(*) AS n FROM closed WHERE deal_outcome = 'Lost' GROUP BY stage)"""))
def lost_stage_share(spark, sf):
    t = m.lost_stage_share(analysis(spark, sf).closed_outcomes)
    return t.select("stage", "n", r6("percent"))


# ---------------------------------------------------------------- scalars
@register("normalise_keys",
          "SELECT p_partkey, regexp_replace(p_name, ' ', '_', 'g') AS p_name FROM part")
def normalise_keys(spark, sf):
    p = testdata.table(spark, sf, "part")
    return p.select("p_partkey", replace_all("p_name", " ", "_").alias("p_name"))


@register("unify_team_labels", with_base(
    "SELECT sales_rep, regexp_replace(team, 'TEAM SMB', 'SMB', 'g') AS team FROM reps", "reps"))
def unify_team_labels(spark, sf):
    reps = analysis(spark, sf).rep_team
    return reps.select("sales_rep", replace_all("team", "TEAM SMB", "SMB").alias("team"))


@register("parse_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d_slashed, CAST(o_orderdate AS DATE) AS d_us,
       CAST(o_orderdate AS DATE) AS d_text, CAST(date_trunc('month', o_orderdate) AS DATE) AS d_month,
       CAST(date_trunc('year', o_orderdate) AS DATE) AS d_year, CAST(NULL AS DATE) AS d_no_year,
       CAST(o_orderdate AS DATE) AS d_default, CAST(NULL AS DATE) AS d_default_us
FROM orders""")
def parse_dates_q(spark, sf):
    o = testdata.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    fmt = {"d_slashed": "yyyy/MM.dd", "d_us": "MM/dd/yyyy", "d_text": "d MMMM yyyy",
           "d_month": "yyyy-MM", "d_year": "yyyy", "d_no_year": "dd.MM"}
    full = parse_date_columns(o, {n: F.date_format("o_orderdate", p) for n, p in fmt.items()},
                              FULL_DATE_ORDERS)
    both = parse_date_columns(full, {
        "d_default": F.date_format("o_orderdate", "yyyy-M-d"),
        "d_default_us": F.date_format("o_orderdate", "MM/dd/yyyy")})
    return both.drop("o_orderdate")


@register("impute_stage_median", with_base("SELECT * FROM imp", "imp"))
def impute_stage_median(spark, sf):
    return analysis(spark, sf).imputed


@register("deal_outcome", with_base("SELECT * EXCLUDE (sales_cycle_days) FROM closed"))
def deal_outcome(spark, sf):
    return m.deal_outcome(analysis(spark, sf).imputed)


@register("if_else_null", with_base("""
SELECT id, team, CASE WHEN (team = 'SMB') IS NULL THEN NULL
                      WHEN team = 'SMB' THEN 'smb' ELSE 'other' END AS team_kind
FROM v1""", "v1"))
def if_else_null_q(spark, sf):
    v1 = analysis(spark, sf).v1
    kind = if_else_null(F.col("team") == "SMB", F.lit("smb"), F.lit("other"))
    return v1.select("id", "team", kind.alias("team_kind"))


@register("factor_codes", with_base("""
SELECT id, team, CASE WHEN team IS NULL THEN NULL
                      ELSE dense_rank() OVER (ORDER BY team) END AS team_code
FROM v1""", "v1"))
def factor_codes(spark, sf):
    from dealflow.operators.profile import factor_codes as codes
    v1 = analysis(spark, sf).v1
    return codes(v1, "team", "team_code").select("id", "team", "team_code")


@register("impute_new_stage", with_base("SELECT * FROM v2", "v2"))
def impute_new_stage(spark, sf):
    return analysis(spark, sf).v2


@register("sales_cycle", with_base(
    "SELECT id, team, deal_outcome, sales_cycle_days FROM closed"))
def sales_cycle(spark, sf):
    return analysis(spark, sf).closed.select("id", "team", "deal_outcome", "sales_cycle_days")


# ---------------------------------------------------------------- exports
def _export(name, table):
    """Write a result table and read it back."""
    return io.export_tables({name: table})[name]


def _register_exports() -> None:
    from dealflow.plans.catalog import ORACLE
    for key, name, fn in (("export_tables", "team_conversion_rates", team_conversion),
                          ("export_won_revenue", "average_revenue_won", won_revenue_by_team),
                          ("export_cycle_by_outcome", "average_cycle_by_outcome", avg_cycle_by_outcome),
                          ("export_team_cycle_medians", "team_level_median_cycle_days", team_cycle_medians)):
        register(key, ORACLE[fn.__name__])(lambda spark, sf, n=name, f=fn: _export(n, f(spark, sf)))


_register_exports()


@register("read_opportunities", with_base("SELECT * FROM opps", "opps"))
def read_opportunities_q(spark, sf):
    """Write the opportunities, then read them with the declared schema."""
    path = shared_path(spark, "opportunities")
    io.write_table(testdata.opportunities(spark, sf), path)
    return io.read_opportunities(spark, path, schema=io.OPPORTUNITY_SCHEMA)


@register("gate_imputed", with_base("SELECT * FROM imp", "imp"))
def gate_imputed(spark, sf):
    """The imputed table as written behind the gate that no change date is missing."""
    from dealflow.plans.flow import SalesAnalysis
    a = analysis(spark, sf)
    own = SalesAnalysis(a.opportunities, a.rep_team)
    own._v1 = a.v1
    return own.commit_imputed().imputed


@register("export_overwrite", with_base("""
SELECT id, team, stage, employees + 1 AS employees FROM v1 WHERE stage <> 'NEW'""", "v1"))
def export_overwrite(spark, sf):
    """One path written three times: other rows, the table, and the table changed
    from what stands there."""
    path = shared_path(spark, "overwritten")
    v1 = analysis(spark, sf).v1.select("id", "team", "stage", "employees")
    io.write_table(v1.where("stage = 'NEW'"), path)
    first = io.write_table(v1, path)
    return io.write_table(first.where("stage <> 'NEW'").withColumn("employees", F.col("employees") + 1), path)


# Faults that the text source below is given, by id.
BAD_NUMBER, SHORT_RECORD, LINE_BREAK = 97, 89, 7


def _faulty_csv(spark, sf) -> str:
    """The opportunities as CSV text, some records with a number that is none,
    without their last value, or with a quoted line break and quotes."""
    o = testdata.opportunities(spark, sf)

    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    company = F.when(F.col("id") % LINE_BREAK == 0, F.concat(
        F.lit('"'), "company", F.lit('\n""and"", sons"'))).otherwise(F.col("company"))
    employees = F.when(F.col("id") % BAD_NUMBER == 0, F.lit("many")).otherwise(text("employees"))
    front = F.concat_ws(",", "id", "opportunity_owner", company, "stage", text("created_date"),
                        text("last_stage_change_date"), employees)
    last = F.when(F.col("id") % SHORT_RECORD == 0, F.lit("")).otherwise(
        F.concat(F.lit(","), text("sold_price_per_registered_member")))
    path = shared_path(spark, "faulty")
    o.select(F.concat(front, last)).write.text(path)
    return path


@register("scan_opportunities_csv", with_base(f"""
SELECT * REPLACE (CASE WHEN id % {LINE_BREAK} = 0 THEN company || chr(10) || '"and", sons' ELSE company END AS company)
FROM opps WHERE id % {BAD_NUMBER} <> 0 AND id % {SHORT_RECORD} <> 0""", "opps"))
def scan_opportunities_csv(spark, sf):
    return io.read_csv_typed(spark, _faulty_csv(spark, sf), io.OPPORTUNITY_SCHEMA, header=False).rows


@register("rejected_rows", with_base(f"""
SELECT id, CASE WHEN id % {BAD_NUMBER} = 0 AND id % {SHORT_RECORD} = 0 THEN 'both'
                WHEN id % {BAD_NUMBER} = 0 THEN 'number' ELSE 'short' END AS fault
FROM opps WHERE id % {BAD_NUMBER} = 0 OR id % {SHORT_RECORD} = 0""", "opps"))
def rejected_rows(spark, sf):
    """The records that the typed scan rejects; what is wrong is read off their text."""
    found = io.read_csv_typed(spark, _faulty_csv(spark, sf), io.OPPORTUNITY_SCHEMA, header=False)
    record = F.col("record")
    number = record.contains(",many")
    short = F.regexp_count(F.regexp_replace(record, F.lit('"[^"]*"'), F.lit("")), F.lit(",")) < 7
    return found.rejected.select(
        F.substring_index(record, ",", 1).cast("long").alias("id"),
        F.when(number & short, "both").when(number, "number").when(short, "short").otherwise("other").alias("fault"))
