"""Typed CSV scans, tables replaced in one step, and the gated write."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.operators.filters import DataQualityError
from dealflow.plans.flow import SalesAnalysis
from dealflow.sources import io

SCHEMA = T.StructType([T.StructField("deal_id", T.LongType()), T.StructField("price", T.DoubleType()),
                       T.StructField("closed", T.DateType())])
LINES = ['Note,Deal ID,Price,Closed', 'plain,1,2.5,2020-01-05', '"two\nlines, ""quoted""",2,,', 'bad,x,1.0,2020-01-05',
         'short,4', 'long,5,1.0,2020-01-05,more', 'date,6,1.0,2020-13-45', ',7,-1e3,1999-12-31']


def test_typed_csv_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(LINES) + "\n")
    scan = io.read_csv_typed(spark, str(tmp_path / "a.csv"), SCHEMA)
    assert (scan.n_rows, scan.n_rejected) == (3, 4)
    assert scan.rows.columns == ["deal_id", "price", "closed", "note"]
    assert sorted(map(tuple, scan.rows.collect())) == [
        (1, 2.5, dt.date(2020, 1, 5), "plain"), (2, None, None, 'two\nlines, "quoted"'),
        (7, -1000.0, dt.date(1999, 12, 31), None)]
    assert sorted(r.record for r in scan.rejected.collect()) == sorted(LINES[k] for k in (3, 4, 5, 6))
    assert all(r.file.endswith("a.csv") for r in scan.rejected.collect())
    # fewer columns read: the same records are good
    assert sorted(r[0] for r in scan.rows.select("price").fillna(0).collect()) == [-1000.0, 0.0, 2.5]
    with pytest.raises(ValueError):
        io.read_csv_typed(spark, str(tmp_path / "a.csv"), SCHEMA.add("absent", T.LongType()))


def test_typed_csv_of_nothing(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("Deal ID,Price,Closed\n")
    scan = io.read_csv_typed(spark, str(tmp_path / "empty.csv"), T.StructType(SCHEMA.fields[:3]))
    assert (scan.n_rows, scan.n_rejected, scan.rows.count(), scan.rejected.count()) == (0, 0, 0, 0)


def left_over(tmp_path):
    return sorted(p for p in os.listdir(tmp_path) if not p.startswith("."))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_failed_write_keeps_the_former_table(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    io.write_table(spark.range(10), path, fmt)
    broken = spark.range(20).select(F.when(F.col("id") < 15, F.col("id")).otherwise(
        F.raise_error(F.lit("no")).cast("long")).alias("id"))
    with pytest.raises(Exception):
        io.write_table(broken, path, fmt)
    assert io.read_table(spark, path, fmt).count() == 10
    # from itself, with other rows
    again = io.write_table(io.read_table(spark, path, fmt, spark.range(1).schema if fmt == "csv" else None)
                           .where("id > 6"), path, fmt)
    assert again.count() == 3
    assert left_over(tmp_path) == ["t"]


def test_crash_inside_the_swap_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_table(spark.range(4), path)
    os.rename(path, path + ".former-0123")  # what a crash between the two renames leaves
    io.recover_table(spark, path)
    assert io.read_table(spark, path).count() == 4 and left_over(tmp_path) == ["t"]
    os.rename(path, path + ".former-0123")
    assert io.write_table(spark.range(2), path).count() == 2
    io.recover_table(spark, str(tmp_path / "never" / "there"))


def test_gate_raises_and_leaves_no_table(spark, tmp_path):
    rows = [(1, "o", "T", "c", "Pitch", dt.date(2020, 1, 1), dt.date(2020, 1, 9), 5, 1.0),
            (2, "o", "T", "c", "Ghost", dt.date(2020, 1, 1), None, 5, 1.0)]
    schema = ("id long, opportunity_owner string, team string, company string, stage string, created_date date, "
              "last_stage_change_date date, employees int, sold_price_per_registered_member double")

    def analysis(which):
        a = SalesAnalysis(None, None)
        a._v1 = spark.createDataFrame(which, schema)
        return a
    path = str(tmp_path / "imputed")
    with pytest.raises(DataQualityError):  # a stage without any date has no median
        analysis(rows).commit_imputed(path)
    assert left_over(tmp_path) == []
    a = analysis(rows[:1]).commit_imputed(path)
    assert a.imputed.count() == 1 and a.closed.count() == 1 and left_over(tmp_path) == ["imputed"]
    with pytest.raises(DataQualityError):
        analysis(rows).commit_imputed(path)
    assert spark.read.parquet(path).count() == 1  # the former one stays
