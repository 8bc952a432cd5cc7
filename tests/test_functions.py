import datetime as dt

from pyspark.sql import functions as F

from dealflow.functions.names import clean_names, snake_name, unique_names
from dealflow.functions.scalars import (FULL_DATE_ORDERS, if_else_null, parse_date_columns,
                                        parse_dates, percent_label, round_half_even)


def test_snake_names():
    names = ["Sold Price (%)", "2nd Date", "A b", "a_B", "# of reps", "createdDate", "Größe"]
    got = unique_names([snake_name(n) for n in names])
    assert got == ["sold_price_percent", "x2nd_date", "a_b", "a_b_2", "number_of_reps",
                   "created_date", "groe"]


def test_clean_names_frame(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["A b", "a_B", "Sold Price (%)"])
    assert clean_names(df).columns == ["a_b", "a_b_2", "sold_price_percent"]


DATES = ["2020-1-5", "2020/01.05", "01/05/2020", "12 March 2020", "2020-03", "2020",
         "12 Mar 2020", "May 2021", "Sept 2020", "12 March", "12", "1-5", "x", None]


def test_parse_dates_default_and_full(spark):
    df = spark.createDataFrame([(s,) for s in DATES], "s string")
    out = df.select("s", parse_dates("s").alias("d"),
                    parse_dates("s", FULL_DATE_ORDERS).alias("full")).collect()
    got = {r.s: (r.d, r.full) for r in out}
    j5 = dt.date(2020, 1, 5)
    assert got["2020-1-5"] == (j5, j5)
    assert got["2020/01.05"] == (j5, j5)
    assert got["01/05/2020"] == (None, j5)
    assert got["12 March 2020"] == (None, dt.date(2020, 3, 12))
    assert got["2020-03"] == (None, dt.date(2020, 3, 1))
    assert got["2020"] == (None, dt.date(2020, 1, 1))
    assert got["12 Mar 2020"] == (None, dt.date(2020, 3, 12))
    assert got["May 2021"] == (None, dt.date(2021, 5, 1))
    assert got["Sept 2020"] == (None, None)  # neither a full nor a 3-letter name
    for s in ["12 March", "12", "1-5", "x", None]:
        assert got[s] == (None, None), s


def test_parse_date_columns_matches_column_form(spark):
    df = spark.createDataFrame([(s,) for s in DATES], "s string")
    a = parse_date_columns(df, {"d": "s"}, FULL_DATE_ORDERS).select("s", "d")
    b = df.select("s", parse_dates("s", FULL_DATE_ORDERS).alias("d"))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_if_else_null_propagates(spark):
    df = spark.createDataFrame([("NEW",), ("Pitch",), (None,)], "stage string")
    out = df.select("stage", if_else_null(F.col("stage") == "NEW", F.lit(1), F.lit(0)).alias("v"))
    got = {r.stage: r.v for r in out.collect()}
    assert got == {"NEW": 1, "Pitch": 0, None: None}


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(1 / 8, 3 / 8, 324.5, 325.5)], "a double, b double, c double, d double")
    r = df.select(round_half_even("a", 2), round_half_even("b", 2), round_half_even("c", 0),
                  round_half_even("d", 0)).first()
    assert tuple(r) == (0.12, 0.38, 324.0, 326.0)


def test_percent_label(spark):
    df = spark.createDataFrame([(0.56,), (0.5,), (0.49,)], "r double")
    assert [r[0] for r in df.select(percent_label("r")).collect()] == ["56%", "50%", "49%"]


def test_normalise_date_text_fast_path_matches_regex(spark):
    from dealflow.functions.scalars import normalise_date_text
    samples = ["2020-01-05", "2020/01.05", "12 March 2020", " 2020-1-5 ", "2020--01//05",
               "01/05/2020", "x", "", "-2020-", "12,March,2020", "2020 / 01 / 05", None]
    df = spark.createDataFrame([(v,) for v in samples], "s string")
    general = F.btrim(F.regexp_replace(F.col("s"), "[^0-9A-Za-z]+", "-"), F.lit("-"))
    rows = df.select(normalise_date_text("s").alias("a"), general.alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_every_day_and_no_other(spark):
    """All combinations of a few years, months and days against the calendar."""
    rows = [(f"{y:04d}-{m}-{d}", f"{m}/{d}/{y:04d}", y, m, d) for y in (1, 1900, 2000, 2023, 2024, 9999)
            for m in range(0, 14) for d in (0, 1, 28, 29, 30, 31, 32)]
    df = spark.createDataFrame(rows, "a string, b string, y int, m int, d int")
    for r in parse_date_columns(df, {"pa": "a", "pb": "b"}, FULL_DATE_ORDERS).collect():
        try:
            want = dt.date(r.y, r.m, r.d)
        except ValueError:
            want = None
        assert r.pa == want and r.pb == want, r


def test_dates_by_name_case_and_odd_tokens(spark):
    want = {"1 JANUARY 2020": dt.date(2020, 1, 1), "1 jan 2020": dt.date(2020, 1, 1), "may, 2020": dt.date(2020, 5, 1),
            "31 April 2020": None, "29 Feb 2023": None, "29-feb-2024": dt.date(2024, 2, 29), "2020-1e-5": None,
            "12 Marches 2020": None, "20200105": None, "2020-001-5": None, "2020-1-5-7": None,
            "": None, "--": None, "2020-1-5 10:00": None, "..2020..": dt.date(2020, 1, 1)}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    got = {r.s: r.d for r in parse_date_columns(df, {"d": "s"}, FULL_DATE_ORDERS).collect()}
    assert got == want
