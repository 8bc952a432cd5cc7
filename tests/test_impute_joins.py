import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealflow.operators.filters import DataQualityError, require_none, where_missing
from dealflow.operators.impute import (group_median_lag, impute_by_group_median,
                                       impute_entry_stage, imputation_summary)
from dealflow.operators.joins import attach_group_stat, lookup_join

D = dt.date
SCHEMA = "id long, stage string, created_date date, last_stage_change_date date"


def test_entry_stage_rule_and_null_stage(spark):
    rows = [(1, "NEW", D(2020, 1, 1), None), (2, "NEW", D(2020, 1, 1), D(2020, 2, 1)),
            (3, None, D(2020, 1, 1), None), (4, None, D(2020, 1, 1), D(2020, 1, 9)),
            (5, "Pitch", D(2020, 1, 1), None)]
    out = {r.id: r for r in impute_entry_stage(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1].last_stage_change_date == D(2020, 1, 1) and out[1].imputed_last_stage is True
    assert out[2].last_stage_change_date == D(2020, 2, 1) and out[2].imputed_last_stage is False
    assert out[3].last_stage_change_date is None and out[3].imputed_last_stage is None
    assert out[4].imputed_last_stage is False
    assert out[5].last_stage_change_date is None and out[5].imputed_last_stage is False


def test_group_median_half_even_and_all_missing(spark):
    # Pitch medians: lags 324 and 325 -> 324.5 -> rounds to 324 (half-even)
    rows = [(1, "Pitch", D(2020, 1, 1), D(2020, 1, 1) + dt.timedelta(324)),
            (2, "Pitch", D(2020, 1, 1), D(2020, 1, 1) + dt.timedelta(325)),
            (3, "Pitch", D(2021, 1, 1), None),
            (4, "Ghost", D(2021, 1, 1), None)]
    df = impute_entry_stage(spark.createDataFrame(rows, SCHEMA))
    med = group_median_lag(df)
    assert {r.stage: r.median_days_to_stage for r in med.collect()} == {"Pitch": 324.5}
    imp = impute_by_group_median(df, med)
    got = {r.id: r for r in imp.collect()}
    assert got[3].last_stage_change_date == D(2021, 1, 1) + dt.timedelta(324)
    assert got[3].imputed_last_stage is True
    assert got[4].last_stage_change_date is None and got[4].imputed_last_stage is True
    summary = {r.imputed_last_stage: (r.total_deals, r.missing_dates_remaining)
               for r in imputation_summary(imp).collect()}
    assert summary == {True: (2, 1), False: (2, 0)}
    with pytest.raises(DataQualityError):
        require_none(where_missing(imp, "last_stage_change_date"), "missing dates")


def test_lookup_join_duplicates_and_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, owner string")
    right = spark.createDataFrame([("a", "T1"), ("a", "T2"), (None, "TN")], "sales_rep string, team string")
    for bound in (10, 0):  # broadcast path and shuffled path
        out = lookup_join(left, right, "owner", "sales_rep", max_broadcast_rows=bound)
        assert "sales_rep" not in out.columns
        got = sorted((r.id, r.team) for r in out.collect())
        assert got == [(1, "T1"), (1, "T2"), (2, None), (3, "TN")]


def test_attach_group_stat_null_group(spark):
    d = spark.createDataFrame([(1, None), (2, "x")], "id long, g string")
    s = spark.createDataFrame([(None, 1.0), ("x", 2.0)], "g string, m double")
    got = sorted((r.id, r.m) for r in attach_group_stat(d, s, "g").collect())
    assert got == [(1, 1.0), (2, 2.0)]
    assert F is not None
