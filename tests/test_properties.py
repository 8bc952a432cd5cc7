import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from conftest import SF_MID
from dealflow.operators import chartdata as cd
from dealflow.operators import metrics as m
from dealflow.operators.impute import group_median_lag, impute_by_group_median, impute_entry_stage
from dealflow.plans.flow import forget, prepare


def test_properties_on_test_tables(spark):
    a = prepare(spark, SF_MID)
    try:
        before = a.v1.select("id", F.col("last_stage_change_date").alias("d0"))
        after = a.imputed.select("id", "last_stage_change_date", "imputed_last_stage")
        j = before.join(after, "id")
        changed = j.where(~F.col("d0").eqNullSafe(F.col("last_stage_change_date"))).count()
        flagged = j.where(F.col("imputed_last_stage")).count()
        assert changed == flagged > 0
        assert j.where(F.col("d0").isNotNull() & F.col("imputed_last_stage")).count() == 0
        teams = m.team_conversion(a.closed_deals).collect()
        overall = m.overall_conversion(a.closed_deals).first()
        assert sum(r.team_volume for r in teams) == overall.total_won + overall.total_lost
        assert sum(r.won for r in teams) == overall.total_won
        share = m.lost_stage_share(a.closed_deals).collect()
        assert math.isclose(sum(r.percent for r in share), 100.0)
        cut = a.v2.where(F.col("employees") < 7000)
        hist = cd.histogram(cut, "employees", 100).collect()
        assert len(hist) == 100 and sum(r["count"] for r in hist) == cut.count()
        box = cd.boxplot_stats(a.closed_deals, ["team", "deal_outcome"], "sales_cycle_days").collect()
        assert all(r.ymin <= r.lower <= r.middle <= r.upper <= r.ymax for r in box)
        outl = cd.boxplot_outliers(a.closed_deals.select("team", "deal_outcome", "sales_cycle_days"),
                                   ["team", "deal_outcome"], "sales_cycle_days").count()
        assert outl == sum(r.n_outliers for r in box)
    finally:
        forget(spark, SF_MID)


STAGES = st_.sampled_from(["NEW", "Pitch", "Won", None])
DAYS = st_.one_of(st_.none(), st_.integers(min_value=0, max_value=400))
ROW = st_.tuples(STAGES, st_.integers(min_value=0, max_value=1000), DAYS)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st_.lists(ROW, min_size=1, max_size=25))
def test_imputation_invariants(spark, rows):
    base = dt.date(2020, 1, 1)
    data = [(i, s, base + dt.timedelta(c), None if d is None else base + dt.timedelta(c + d))
            for i, (s, c, d) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, stage string, created_date date, "
                                     "last_stage_change_date date")
    v2 = impute_entry_stage(df)
    med = {r.stage: r.median_days_to_stage for r in group_median_lag(v2).collect()}
    out = {r.id: r for r in impute_by_group_median(v2, group_median_lag(v2)).collect()}
    for i, stage, created, d in data:
        r = out[i]
        if d is not None:  # present dates never change, never flagged
            assert r.last_stage_change_date == d and r.imputed_last_stage is False
        elif stage is None:  # NULL condition propagates
            assert r.last_stage_change_date is None and r.imputed_last_stage is None
        elif stage == "NEW":
            assert r.last_stage_change_date == created and r.imputed_last_stage is True
        else:
            assert r.imputed_last_stage is True
            if stage in med:
                shift = round(med[stage])  # Python rounds half to even, like bround
                assert r.last_stage_change_date == created + dt.timedelta(shift)
            else:
                assert r.last_stage_change_date is None
