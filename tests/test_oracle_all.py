"""Every SQL-checkable query against its DuckDB oracle at sf0.001."""

import contextlib
import datetime as dt
import io
import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings"]
NAMES = sorted(entry.oracle_sql())


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def prepared(spark):
    from dealflow.plans.flow import forget, prepare
    prepare(spark, SF_SMALL)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    forget(spark, SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, prepared, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    res = prepared.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, res.fetchall())


QUANTILE_QUERIES = ["stage_median_days", "impute_stage_median", "won_revenue_by_team",
                    "avg_cycle_by_outcome", "team_cycle_medians", "cycle_boxplot",
                    "cycle_outliers", "profile_numeric", "profile_date", "imputation_summary"]


@pytest.mark.parametrize("name", QUANTILE_QUERIES)
def test_rank_selection_path_matches_oracle(spark, name, monkeypatch):
    """Every grouped median/quartile forced through the radix selection
    (the path taken when the groups have too many values for one task)."""
    from dealflow.operators import ordering
    from dealflow.plans.flow import forget
    forget(spark, SF_SMALL)  # plan from the tables, not from a prepared analysis
    monkeypatch.setattr(ordering, "GROUP_STATE_MAX_VALUES", 1)
    calls = []
    real = ordering._radix_select
    monkeypatch.setattr(ordering, "_radix_select",
                        lambda *a, **k: calls.append(1) or real(*a, **k))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF_SMALL)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, res.fetchall())
    assert calls, "radix selection was not used"


JOIN_QUERIES = ["join_rep_team", "join_stage_median", "impute_stage_median", "team_conversion",
                "factor_codes", "spearman_size_cycle", "cycle_boxplot", "scan_opportunities",
                "won_revenue_by_team", "team_cycle_medians"]


@pytest.mark.parametrize("name", JOIN_QUERIES)
def test_shuffle_join_path_matches_oracle(spark, name, monkeypatch):
    """Every lookup too big to broadcast: shuffle joins (null-safe keys) only,
    as on large inputs. What is still broadcast is bounded by the number of
    partitions: the pieces of hot keys and the offsets of partitions."""
    from dealflow.operators import joins
    from dealflow.plans.flow import forget
    forget(spark, SF_SMALL)
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 1)
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
        sdf = entry.queries()[name](spark, SF_SMALL)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            sdf.explain()
        plan = buf.getvalue()
        got = [tuple(r) for r in sdf.collect()]
        res = con.execute(entry.oracle_sql()[name])
        dcols = [d[0] for d in res.description]
        assert _rows(sdf.columns, got) == _rows(dcols, res.fetchall())
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_hot_h" not in x and "_ord_p" not in x]
    finally:
        spark.conf.set(key, old)


@pytest.mark.parametrize("name", ["team_conversion", "chart_win_rate_bars", "lost_stage_share"])
def test_no_window_over_whole_tables(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        entry.queries()[name](spark, SF_SMALL).explain()
    assert "Window [" not in buf.getvalue()
