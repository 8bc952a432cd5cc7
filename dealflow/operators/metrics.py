"""Win rates, ranking, deal size, sales cycle and distribution tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.functions.scalars import round_half_even, safe_ratio
from dealflow.operators.aggregates import (count_by, count_where, dense_rank_desc, pivot_wider,
                                          share_of_total)
from dealflow.operators.filters import where_equal, where_in, where_missing, where_present
from dealflow.operators.joins import join_small
from dealflow.operators.ordering import grouped_quantiles

# Outcome labels and the stages that map to them.
WON, LOST, OPEN = "Won", "Lost", "Open"
WON_STAGE, LOST_STAGE = "Closed Won", "Closed Lost"
CLOSED = (WON, LOST)


def deal_outcome(df: DataFrame, stage: str = "stage", name: str = "deal_outcome",
                 won_stage: str = WON_STAGE, lost_stage: str = LOST_STAGE) -> DataFrame:
    """Won / Lost from the stage; everything else (NULL stage too) is Open."""
    return df.withColumn(name, F.when(F.col(stage) == won_stage, F.lit(WON))
                         .when(F.col(stage) == lost_stage, F.lit(LOST))
                         .otherwise(F.lit(OPEN)))


def closed_only(df: DataFrame, outcome: str = "deal_outcome") -> DataFrame:
    return where_in(df, outcome, CLOSED)


def closed_stages(df: DataFrame, stage: str = "stage", won_stage: str = WON_STAGE,
                  lost_stage: str = LOST_STAGE) -> DataFrame:
    """Closed deals selected by stage: same rows as ``closed_only`` after
    ``deal_outcome``, but a plain IN on a stored column reaches the Parquet
    scan as a pushed filter."""
    return where_in(df, stage, [won_stage, lost_stage])


def _median(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    return grouped_quantiles(df.select(*groups, value), groups, value, [0.5], [name])


def _rate(won, lost):
    return round_half_even(safe_ratio(won, won + lost), 2)


def overall_conversion(df: DataFrame, outcome: str = "deal_outcome") -> DataFrame:
    """Total won, total lost and the won share of closed deals (2 digits)."""
    o = F.col(outcome)
    agg = closed_only(df, outcome).agg(
        count_where(o == WON).alias("total_won"),
        count_where(o == LOST).alias("total_lost"))
    return agg.withColumn("conversion_rate", _rate(F.col("total_won"), F.col("total_lost")))


def team_conversion(df: DataFrame, team: str = "team",
                    outcome: str = "deal_outcome") -> DataFrame:
    """Per team: won, lost, rate (2 digits), volume, dense rank on the
    rounded rate (ties share a rank). Sorted best first."""
    o = F.col(outcome)
    per = (closed_only(df, outcome).groupBy(team)
           .agg(count_where(o == WON).alias("won"), count_where(o == LOST).alias("lost"))
           .withColumn("conversion_rate", _rate(F.col("won"), F.col("lost")))
           .withColumn("team_volume", F.col("won") + F.col("lost")))
    ranked = dense_rank_desc(per, "conversion_rate", "team_rank")
    return (ranked.select("team_rank", team, "won", "lost", "conversion_rate", "team_volume")
            .orderBy(F.col("conversion_rate").desc_nulls_last(), F.col(team).asc_nulls_last()))


def won_revenue_by_team(df: DataFrame, team: str = "team",
                        price: str = "sold_price_per_registered_member",
                        outcome: str = "deal_outcome") -> DataFrame:
    """Won deals with a price: mean, median, count, and round(mean, 2) * count."""
    won = where_present(where_equal(df, outcome, WON), price)
    per = won.groupBy(team).agg(
        F.avg(price).alias("avg_sold_price"),
        F.count(F.lit(1)).alias("won_deals_count"))
    per = join_small(per, _median(won, [team], price, "median_sold_price"), team)
    per = per.select(team, "avg_sold_price", "median_sold_price", "won_deals_count")
    per = per.withColumn("total_revenue",
                         round_half_even(F.col("avg_sold_price"), 2) * F.col("won_deals_count"))
    return per.orderBy(F.col("avg_sold_price").desc_nulls_last(), F.col(team).asc_nulls_last())


def sales_cycle(df: DataFrame, start: str = "created_date",
                end: str = "last_stage_change_date",
                name: str = "sales_cycle_days") -> DataFrame:
    """Whole days from start to end for every deal (negative allowed)."""
    return df.withColumn(name, F.datediff(F.col(end), F.col(start)).cast("double"))


def avg_cycle_by_outcome(df: DataFrame, cycle: str = "sales_cycle_days",
                         outcome: str = "deal_outcome") -> DataFrame:
    closed = closed_only(df, outcome)
    mom = closed.groupBy(outcome).agg(F.avg(cycle).alias("avg_cycle_days"),
                                      F.stddev_samp(cycle).alias("sd_cycle_days"))
    med = _median(closed, [outcome], cycle, "median_cycle_days")
    return join_small(mom, med, outcome).select(
        outcome, "avg_cycle_days", "median_cycle_days", "sd_cycle_days")


def lost_stage_share(df: DataFrame, stage: str = "stage",
                     outcome: str = "deal_outcome") -> DataFrame:
    """Final stage of lost deals: count and percent of all lost deals."""
    counts = count_by(where_equal(df, outcome, LOST), stage)
    return (share_of_total(counts, "n", "percent")
            .orderBy(F.col("n").desc(), F.col(stage).asc_nulls_last()))


def team_cycle_medians(df: DataFrame, team: str = "team", cycle: str = "sales_cycle_days",
                       outcome: str = "deal_outcome", prefix: str = "cycle_") -> DataFrame:
    """Median cycle per team for Lost and Won side by side (NULL if a team has
    none): grouped medians per (team, outcome), then a pivot of that small
    table."""
    closed = closed_only(df, outcome)
    med = _median(closed, [team, outcome], cycle, "__median")
    teams = closed.select(team).distinct()
    wide = pivot_wider(med, team, outcome, "__median", [LOST, WON], prefix)
    return join_small(teams, wide, team)


def missing_by_stage(df: DataFrame, target: str = "last_stage_change_date",
                     stage: str = "stage") -> DataFrame:
    return (count_by(where_missing(df, target), stage, name="count")
            .orderBy(F.col("count").desc(), F.col(stage).asc_nulls_last()))


def price_by_stage(df: DataFrame, stage: str = "stage",
                   price: str = "sold_price_per_registered_member") -> DataFrame:
    """Rows per (stage, price), NULL price as its own group, most frequent first."""
    return (count_by(df, stage, price, name="count")
            .orderBy(F.col("count").desc(), F.col(stage).asc_nulls_last(),
                     F.col(price).asc_nulls_last()))
