import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dealflow.plans.catalog import QUERIES
from dealflow.plans.flow import SalesAnalysis, forget, ingest, ingest_rep_team, prepare
from dealflow.sources import io
from dealflow.operators import metrics as m


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_prepared_equals_lazy(spark):
    names = ["team_conversion", "imputation_summary", "avg_cycle_by_outcome", "price_by_stage",
             "profile_date", "cycle_boxplot", "null_profile", "spearman_size_cycle"]
    lazy = {n: _rows(QUERIES[n](spark, SF_SMALL)) for n in names}
    prepare(spark, SF_SMALL)
    try:
        for n in names:
            assert _rows(QUERIES[n](spark, SF_SMALL)) == lazy[n], n
    finally:
        forget(spark, SF_SMALL)


def test_prepared_keeps_blank_and_null_stages(spark):
    day = dt.date(2020, 1, 1)
    opps = spark.createDataFrame(
        [(1, "a", "", day, None), (2, "a", None, day, None), (3, "a", "NEW", day, None), (4, "a", "", day, day)],
        "id long, opportunity_owner string, stage string, created_date date, last_stage_change_date date")
    reps = spark.createDataFrame([("a", "SMB")], "sales_rep string, team string")
    lazy = _rows(SalesAnalysis(opps, reps).imputed)
    stored = SalesAnalysis(opps, reps).materialize(sort_by=["stage"])
    assert _rows(stored.imputed) == lazy


def test_gate_stops_the_flow(spark):
    from dealflow.operators.filters import DataQualityError
    opps = spark.createDataFrame([(1, "a", "Pitch", dt.date(2020, 1, 1), None)],
                                 "id long, opportunity_owner string, stage string, created_date date, "
                                 "last_stage_change_date date")
    reps = spark.createDataFrame([("a", "SMB")], "sales_rep string, team string")
    with pytest.raises(DataQualityError):
        SalesAnalysis(opps, reps).require_complete()


def test_raw_ingest_end_to_end(spark):
    raw = spark.createDataFrame([
        ("Ann Lee", "Acme GmbH", "Closed Won", "2020/01.05", "2020-02-01", 12, 35.0, None),
        ("Bob Ray", "Beta AG", "NEW", "2020-1-7", None, 3, None, None),
        (None, None, None, None, None, None, None, None),
        ("Ann Lee", "Gamma", "Closed Lost", "2020-01-09", "2020-01-19", 50, None, None),
    ], "`Opportunity Owner` string, `Company Name` string, Stage string, `Created Date` string, "
       "`Last Stage Change Date` string, Employees int, `Sold Price Per Registered Member` double, "
       "Notes string")
    reps = spark.createDataFrame([("Ann Lee", "TEAM SMB"), ("Bob Ray", "Nord")], "`Sales Rep` string, Team string")
    opps = ingest(raw, id_order=["created_date", "company_name"])
    assert opps.columns[0] == "id" and "notes" not in opps.columns
    assert dict(opps.dtypes)["created_date"] == "date"
    got = {r.id: r for r in opps.collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].created_date == dt.date(2020, 1, 5)
    a = SalesAnalysis(opps, ingest_rep_team(reps))
    teams = {r.opportunity_owner: r.team for r in a.v1.collect()}
    assert teams == {"Ann_Lee": "SMB", "Bob_Ray": "Nord"}
    imp = {r.id: r for r in a.imputed.collect()}
    assert imp[2].last_stage_change_date == dt.date(2020, 1, 7) and imp[2].imputed_last_stage
    t = m.team_conversion(a.closed_deals).collect()
    assert [(r.team, r.won, r.lost, r.conversion_rate) for r in t] == [("SMB", 1, 1, 0.5)]


def test_csv_round_trip_and_export(spark):
    df = spark.createDataFrame([(1, "a", dt.date(2020, 1, 1)), (2, None, None)],
                               "id long, s string, d date")
    out = tempfile.mkdtemp(prefix="dealflow-test-")
    back = io.write_table(df, os.path.join(out, "t.csv"), "csv")
    assert _rows(back) == _rows(df)
    exported = io.export_tables({"x": df}, out)
    assert _rows(exported["x"]) == _rows(df)
    head = io.preview_head(spark.range(100).withColumn("v", F.col("id") * 2), "id", 6)
    assert [r.id for r in head.collect()] == [0, 1, 2, 3, 4, 5]


def test_report_runs(spark):
    from dealflow.plans.report import EXPORT_NAMES, run_report
    a = prepare(spark, SF_SMALL)
    try:
        res = run_report(spark, a, tempfile.mkdtemp(prefix="dealflow-report-"), seed=1, show=False)
        for name in EXPORT_NAMES:
            assert res[name].count() > 0
        assert res["remaining_missing"].count() == 0
        assert {"profile_numeric", "profile_categorical", "profile_date", "profile_boolean"} <= set(res)
    finally:
        forget(spark, SF_SMALL)  # deletes the prepared table that the results read


def test_csv_text_ingest_with_types(spark):
    out = tempfile.mkdtemp(prefix="dealflow-csv-")
    raw = spark.createDataFrame(
        [("Ann Lee", "Acme", "NEW", "2020-01-05", None, "12", "x"),
         ("Bob Ray", "Beta", "Closed Won", "01/07/2020", "2020-02-01", "7", "35.5")],
        "`Opportunity Owner` string, Company string, Stage string, `Created Date` string, "
        "`Last Stage Change Date` string, Employees string, `Sold Price Per Registered Member` string")
    raw.coalesce(1).write.option("header", "true").csv(os.path.join(out, "o"))
    text = io.read_opportunities(spark, os.path.join(out, "o"), "csv")
    assert all(t == "string" for _, t in text.dtypes)
    opps = ingest(text, id_order=["opportunity_owner"], types=io.OPPORTUNITY_TYPES)
    d = dict(opps.dtypes)
    assert d["employees"] == "int" and d["sold_price_per_registered_member"] == "double"
    got = {r.opportunity_owner: r for r in opps.collect()}
    assert got["Ann Lee"].sold_price_per_registered_member is None  # "x" does not convert
    assert got["Bob Ray"].employees == 7 and got["Bob Ray"].created_date is None  # default orders


def test_materialize_drops_empty_columns_observed_in_write(spark):
    opps = spark.createDataFrame(
        [(1, "a", "NEW", dt.date(2020, 1, 1), None, None), (2, "b", "Closed Won", dt.date(2020, 1, 2),
                                                            dt.date(2020, 1, 5), None),
         (3, "a", None, dt.date(2020, 1, 3), None, None)],
        "id long, opportunity_owner string, stage string, created_date date, "
        "last_stage_change_date date, notes string")
    reps = spark.createDataFrame([("a", "SMB")], "sales_rep string, team string")
    a = SalesAnalysis(opps, reps).materialize(
        tempfile.mkdtemp(prefix="dealflow-mat-") + "/v1", drop_empty_of=opps.columns,
        sort_by=["stage"])
    assert "notes" not in a.v1.columns and "last_stage_change_date" in a.v1.columns
    assert a.v1.columns[:3] == ["id", "opportunity_owner", "team"]
    assert {r.id: (r.team, r.stage) for r in a.v1.collect()} == {
        1: ("SMB", "NEW"), 2: (None, "Closed Won"), 3: ("SMB", None)}
    imp = {r.id: r for r in a.imputed.collect()}
    assert imp[3].imputed_last_stage is None and imp[3].last_stage_change_date is None
    assert a.closed_deals.count() == 1


def test_report_cli_on_csv_inputs(spark):
    import subprocess
    import sys

    from conftest import ROOT
    from dealflow.sources import testdata
    base = tempfile.mkdtemp(prefix="dealflow-cli-")
    opps = testdata.opportunities(spark, SF_SMALL).drop("id")  # ids assigned at ingest
    # headers as a spreadsheet would have them; ingest cleans them
    messy = opps.toDF(*[c.replace("_", " ").title() for c in opps.columns]).coalesce(2)
    messy.write.option("header", "true").csv(f"{base}/opps")
    reps = testdata.sales_rep_team(spark, SF_SMALL)
    reps.toDF("Sales Rep", "Team").write.option("header", "true").csv(f"{base}/reps")
    out = subprocess.run(
        [sys.executable, "-m", "dealflow.plans.report", "--opportunities", f"{base}/opps",
         "--rep-team", f"{base}/reps", "--format", "csv", "--out", f"{base}/out",
         "--master", "local[2]", "--seed", "3"],
        cwd=ROOT, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "== team_conversion_rates" in out.stdout
    got = spark.read.parquet(f"{base}/out/team_conversion_rates")
    want = QUERIES["team_conversion"](spark, SF_SMALL)
    key = ["team", "won", "lost", "conversion_rate", "team_volume"]
    assert _rows(got.select(*key)) == _rows(want.select(*key))


def test_ingest_ids_follow_read_order(spark):
    base = tempfile.mkdtemp(prefix="dealflow-order-")
    names = ["zoe", "adam", "mia", "bob", "eve", "carl"]
    with open(f"{base}/o.csv", "w") as f:
        f.write("Opportunity Owner,Stage\n")
        for i, n in enumerate(names):
            f.write(f"{n},{'NEW' if i % 2 else ''}\n")
        f.write(",\n")  # a blank row: dropped before numbering
    df = ingest(io.read_opportunities(spark, f"{base}/o.csv", "csv"))
    got = [r.opportunity_owner for r in df.orderBy("id").collect()]
    assert got == names
    assert [r.id for r in df.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]


def test_unprepared_queries_read_stored_rows(spark):
    """Scan and joins run once: every frame of a query reads the written ``v1``."""
    from dealflow.plans.flow import analysis
    a = analysis(spark, SF_SMALL)
    for frame in (a.v1, a.v2, a.imputed, a.closed_deals, a.closed_outcomes):
        files = frame.inputFiles()
        assert files and all("/v1-" in f for f in files)
    assert all("/opportunities-" in f for f in a.opportunities.inputFiles())
