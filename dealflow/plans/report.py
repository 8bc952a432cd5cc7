"""The whole analysis as one run: read, clean, impute, measure, test, export.

    python -m dealflow.plans.report --opportunities PATH --rep-team PATH \\
        [--format parquet|csv] [--out DIR] [--seed N]
    python -m dealflow.plans.report --testdata /root/testdata/sf0.01

Prints each result table and writes the four export tables (team win rates,
won revenue, cycle by outcome, team median cycle) under ``--out`` (default:
a folder below the shared checkpoint folder).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.operators import chartdata as cd
from dealflow.operators import metrics as m
from dealflow.operators import profile as pr
from dealflow.operators import stats as st
from dealflow.operators.permutation import REPLICATES
from dealflow.operators.aggregates import null_profile
from dealflow.operators.filters import where_missing
from dealflow.operators.impute import imputation_summary
from dealflow.plans.flow import SalesAnalysis, ingest, ingest_rep_team, prepare
from dealflow.plans.q_chart import BINS, EMPLOYEE_CUT
from dealflow.session import get_session
from dealflow.sources import io

EXPORT_NAMES = ("team_conversion_rates", "average_revenue_won", "average_cycle_by_outcome",
                "team_level_median_cycle_days")


def run_report(spark: SparkSession, a: SalesAnalysis, out_dir: str | None = None,
               seed: int = 0, show: bool = True) -> dict[str, DataFrame]:
    """Compute every result of the analysis from a prepared ``SalesAnalysis``."""
    a.commit_imputed()
    closed, outcomes = a.closed_deals, a.closed_outcomes
    long = st.contingency(outcomes, "team", "deal_outcome", [m.LOST, m.WON])
    rates = m.team_conversion(outcomes)
    results: dict[str, DataFrame] = {
        "preview": io.preview_head(a.v1),
        "null_profile": null_profile(a.v1),
        "missing_by_stage": m.missing_by_stage(a.v1),
        "imputation_summary": imputation_summary(a.imputed),
        "remaining_missing": where_missing(a.imputed, "last_stage_change_date"),
        "price_by_stage": m.price_by_stage(a.v2),
        "employee_histogram": cd.histogram(a.v2.where(F.col("employees") < EMPLOYEE_CUT),
                                           "employees", BINS),
        "overall_conversion": m.overall_conversion(outcomes),
        "fisher": st.fisher_mc(spark, long, "team", "deal_outcome",
                               replicates=REPLICATES["fisher"], seed=seed),
        "chi_square": st.chi_square_mc(spark, long, "team", "deal_outcome",
                                       replicates=REPLICATES["chisq"], seed=seed),
        "lost_stage_share": m.lost_stage_share(outcomes),
        "spearman": st.spearman(a.closed, "employees", "sales_cycle_days"),
        "win_rate_bars": cd.win_rate_bars(rates),
        "cycle_boxplot": cd.boxplot_stats(closed, ["team", "deal_outcome"], "sales_cycle_days"),
    }
    for kind, frame in pr.skim(a.v2).items():
        results[f"profile_{kind}"] = frame
    exports = dict(zip(EXPORT_NAMES, (
        rates, m.won_revenue_by_team(outcomes), m.avg_cycle_by_outcome(closed),
        m.team_cycle_medians(closed))))
    results.update(io.export_tables(exports, out_dir))
    if show:
        for name, frame in results.items():
            print(f"== {name}")
            print(" | ".join(frame.columns))
            for r in frame.toLocalIterator():  # whole tables, a partition at a time
                print(" | ".join("" if v is None else str(v) for v in r))
    return results


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--opportunities")
    ap.add_argument("--rep-team")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--testdata", help="a generated test folder instead of the two inputs")
    ap.add_argument("--out")
    ap.add_argument("--seed", type=int, default=0)
    ap.add_argument("--master")
    args = ap.parse_args(argv)
    spark = get_session(args.master)
    if args.testdata:
        a = prepare(spark, args.testdata)
    else:
        if not (args.opportunities and args.rep_team):
            ap.error("--opportunities and --rep-team are required without --testdata")
        types = io.OPPORTUNITY_TYPES if args.format == "csv" else None
        opps = ingest(io.read_opportunities(spark, args.opportunities, args.format), types=types)
        reps = ingest_rep_team(io.read_rep_team(spark, args.rep_team, args.format))
        a = SalesAnalysis(opps, reps).materialize()
    run_report(spark, a, args.out, args.seed)
    spark.stop()


if __name__ == "__main__":
    main()
