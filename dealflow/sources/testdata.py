"""Opportunity and rep-to-team views over the generated test tables.

The original inputs are two spreadsheets that are not available; these views
derive the same shapes from ``orders``, ``customer`` and ``lineitem`` so that
every query's work grows with those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Order status / priority to pipeline stage, and price per
# market segment for won deals.
STATUS_STAGE = {"F": "Closed Won", "P": "Closed Lost"}
PRIORITY_STAGE = {
    "1-URGENT": "NEW",
    "2-HIGH": "Pitch Arranged",
    "3-MEDIUM": "Pitch Took Place",
    "4-NOT SPECIFIED": "Contract Shipped",
    "5-LOW": "Contract Received",
}
SEGMENT_PRICE = {"HOUSEHOLD": 35.0, "MACHINERY": 30.0}
OTHER_PRICE = 33.0
# Every 50th customer has no rep-to-team entry, so some owners stay unmatched.
UNLISTED_EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None
                else expr.when(col == k, F.lit(v)))
    return expr.otherwise(default) if default is not None else expr


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: orders x customer, with the first ship date on or
    after the order date from lineitem.

    Orders are scanned once: the order/customer rows are left-joined to
    lineitem on the order key (both sides shuffled once on it) and reduced
    per order key in the same partitioning.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    stage = F.coalesce(_case(F.col("o_orderstatus"), STATUS_STAGE),
                       _case(F.col("o_orderpriority"), PRIORITY_STAGE))
    price = F.when(F.col("o_orderstatus") == "F",
                   _case(F.col("c_mktsegment"), SEGMENT_PRICE, F.lit(OTHER_PRICE)).cast("double"))
    rows = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        "o_orderkey",
        F.col("c_name").alias("opportunity_owner"),
        F.concat(F.lit("Company "), F.col("o_custkey").cast("string")).alias("company"),
        stage.alias("stage"),
        F.col("o_orderdate"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("int").alias("employees"),
        price.alias("sold_price_per_registered_member"))
    shipped = rows.join(li, (li.l_orderkey == rows.o_orderkey)
                        & (li.l_shipdate >= rows.o_orderdate), "left")
    carried = ["opportunity_owner", "company", "stage", "o_orderdate", "employees",
               "sold_price_per_registered_member"]
    # the carried columns are determined by the order key: grouping by them
    # too keeps a hash aggregate, and the order-key partitioning of the join
    # already satisfies it (no further exchange)
    per_order = shipped.groupBy("o_orderkey", *carried).agg(
        F.min(F.col("l_shipdate").cast("date")).alias("last_stage_change_date"))
    return per_order.select(
        F.col("o_orderkey").alias("id"), "opportunity_owner", "company", "stage",
        F.col("o_orderdate").cast("date").alias("created_date"), "last_stage_change_date",
        "employees", "sold_price_per_registered_member")


def sales_rep_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    team = F.when(F.col("c_mktsegment") == "HOUSEHOLD",
                  F.when(F.col("c_custkey") % 2 == 0, F.lit("SMB")).otherwise(F.lit("TEAM SMB"))
                  ).otherwise(F.col("c_mktsegment"))
    # these owners have a lookup row under another name, so their deals match none
    rep = F.when(F.col("c_custkey") % UNLISTED_EVERY == 0, F.concat(F.lit("Former "), "c_name")).otherwise(
        F.col("c_name"))
    return cust.select(rep.alias("sales_rep"), team.alias("team"))
