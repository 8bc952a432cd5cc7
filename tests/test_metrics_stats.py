import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealflow.operators import metrics as m
from dealflow.operators import montecarlo as mc
from dealflow.operators import stats as st

SCHEMA = "team string, deal_outcome string, sales_cycle_days double"


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_zero_closed_rate_is_null(spark):
    df = _frame(spark, [("A", "Open", 1.0)])
    r = m.overall_conversion(df).first()
    assert (r.total_won, r.total_lost, r.conversion_rate) == (0, 0, None)
    assert m.team_conversion(df).count() == 0


def test_tied_rates_dense_rank(spark):
    rows = ([("A", "Won", 1.0)] * 1 + [("A", "Lost", 1.0)] * 7      # 1/8 -> 0.12
            + [("B", "Won", 1.0)] * 3 + [("B", "Lost", 1.0)] * 5    # 3/8 -> 0.38
            + [("C", "Won", 1.0)] * 38 + [("C", "Lost", 1.0)] * 62  # 0.38
            + [("D", "Won", 1.0)] * 1 + [("D", "Lost", 1.0)] * 9)   # 0.10
    t = {r.team: r for r in m.team_conversion(_frame(spark, rows)).collect()}
    assert t["A"].conversion_rate == 0.12 and t["B"].conversion_rate == 0.38
    assert (t["B"].team_rank, t["C"].team_rank, t["A"].team_rank, t["D"].team_rank) == (1, 1, 2, 3)
    for r in t.values():
        assert r.won + r.lost == r.team_volume


def test_single_row_group_and_absent_cell(spark):
    rows = [("A", "Won", 5.0), ("B", "Won", 3.0), ("B", "Lost", 7.0), ("B", "Lost", 9.0)]
    df = _frame(spark, rows)
    by = {r.deal_outcome: r for r in m.avg_cycle_by_outcome(df.where(F.col("team") == "A")).collect()}
    assert by["Won"].sd_cycle_days is None and by["Won"].median_cycle_days == 5.0
    med = {r.team: (r.cycle_Lost, r.cycle_Won) for r in m.team_cycle_medians(df).collect()}
    assert med == {"A": (None, 5.0), "B": (8.0, 3.0)}
    long = {(r.team, r.deal_outcome): r.n for r in st.contingency(df, "team", "deal_outcome",
                                                                 ["Lost", "Won"]).collect()}
    assert long[("A", "Lost")] == 0 and long[("B", "Lost")] == 2


def test_lost_share_sums_to_100(spark):
    df = spark.createDataFrame([("Closed Lost", "Lost")] * 3 + [("Other", "Lost")], "stage string, deal_outcome string")
    rows = m.lost_stage_share(df).collect()
    assert math.isclose(sum(r.percent for r in rows), 100.0)
    assert rows[0].stage == "Closed Lost" and rows[0].n == 3


def test_zero_margin_dropped_and_refused(spark):
    df = _frame(spark, [("A", "Won", 1.0), ("B", "Won", 2.0)])
    long = st.contingency(df, "team", "deal_outcome", ["Lost", "Won"])
    assert {r.deal_outcome for r in long.collect()} == {"Won"}
    with pytest.raises(ValueError):
        st.chi_square_mc(spark, long, "team", "deal_outcome", replicates=10)


def test_fisher_two_by_two_exact(spark):
    rows = [("A", "Won", 1.0)] * 3 + [("A", "Lost", 1.0)] + [("B", "Won", 1.0)] + [("B", "Lost", 1.0)] * 3
    long = st.contingency(_frame(spark, rows), "team", "deal_outcome", ["Lost", "Won"])
    r = st.fisher_mc(spark, long, "team", "deal_outcome").first()
    assert r.method == "exact"
    assert abs(r.p_value - 0.4857142857) < 1e-9


def _table_3x2(spark):
    rows = ([("A", "Won", 1.0)] * 30 + [("A", "Lost", 1.0)] * 20 + [("B", "Won", 1.0)] * 20
            + [("B", "Lost", 1.0)] * 30 + [("C", "Won", 1.0)] * 25 + [("C", "Lost", 1.0)] * 25)
    return st.contingency(_frame(spark, rows), "team", "deal_outcome", ["Lost", "Won"])


def test_chi_square_matches_ml(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.stat import ChiSquareTest
    long = _table_3x2(spark)
    ours = st.chi_square(long, "team", "deal_outcome").first()
    rows = []
    for r in long.collect():
        rows += [(float(ord(r.team)), Vectors.dense([0.0 if r.deal_outcome == "Lost" else 1.0]))] * r.n
    ml = ChiSquareTest.test(spark.createDataFrame(rows, ["label", "features"]), "features", "label").first()
    assert math.isclose(ours.statistic, ml.statistics[0], rel_tol=1e-12)
    assert ours.df == ml.degreesOfFreedom[0] == 2


def test_monte_carlo_p_reproducible_and_bounded(spark):
    long = _table_3x2(spark)
    a = st.chi_square_mc(spark, long, "team", "deal_outcome", replicates=4000, seed=7).first()
    b = st.chi_square_mc(spark, long, "team", "deal_outcome", replicates=4000, seed=7).first()
    assert a.p_value == b.p_value
    assert 1 / 4001 <= a.p_value <= 1
    # exact p by enumerating every table with these margins (Won column is
    # multivariate hypergeometric); the simulation must agree within ~4 sd
    rows, won = [50, 50, 50], 75
    total = sum(rows)
    exp_w = [r * won / total for r in rows]
    exp_l = [r - e for r, e in zip(rows, exp_w)]

    def stat(ws):
        return sum((w - e) ** 2 / e + ((r - w) - el) ** 2 / el
                   for w, e, r, el in zip(ws, exp_w, rows, exp_l))

    obs, p_exact = stat([30, 20, 25]), 0.0
    denom = math.comb(total, won)
    for x1 in range(51):
        for x2 in range(51):
            x3 = won - x1 - x2
            if 0 <= x3 <= 50 and stat([x1, x2, x3]) >= obs * (1 - 1e-12):
                p_exact += math.comb(50, x1) * math.comb(50, x2) * math.comb(50, x3) / denom
    sd = math.sqrt(p_exact * (1 - p_exact) / 4000)
    assert abs(a.p_value - p_exact) < 4 * sd + 1 / 4001
    f = st.fisher_mc(spark, long, "team", "deal_outcome", replicates=2000, seed=7).first()
    assert f.method == "simulated" and 1 / 2001 <= f.p_value <= 1


def test_split_keeps_margins():
    rng = np.random.default_rng(1)
    for cols in ([4, 8, 9], [2 * 10**11, 2 * 10**11 + 5, 7]):
        pool = np.tile(np.array(cols), (500, 1))
        drawn = mc.split(rng, pool, sum(cols) // 3)
        assert (drawn.sum(axis=1) == sum(cols) // 3).all() and (drawn >= 0).all() and (drawn <= pool).all()


def _chi(counts, probs):
    keep = probs * counts.sum() >= 5
    e = probs[keep] * counts.sum()
    return ((counts[keep] - e) ** 2 / e).sum(), int(keep.sum())


@pytest.mark.parametrize("good,bad,n", [(5, 4 * 10**11, 4 * 10**10), (4 * 10**10, 4 * 10**11, 5),
                                        (60, 2 * 10**9, 5 * 10**8), (2 * 10**9, 60, 10**9)])
def test_large_draws_have_the_exact_distribution(good, bad, n):
    m = 40000
    x = mc.hypergeometric(np.random.default_rng(3), np.full(m, good), np.full(m, bad), np.full(m, n))
    low, high = max(0, n - bad), min(n, good)
    xs = np.arange(low, high + 1) if high - low < 100 else np.arange(low, low + 100)
    logs = np.array([math.lgamma(good + 1) - math.lgamma(k + 1) - math.lgamma(good - k + 1) if good < 100 else 0.0
                     for k in xs.tolist()])
    # with few of one kind in a huge table the draw is binomial up to 1e-8
    small, share, flip = (good, n / (good + bad), False) if good < 100 else (
        (n, good / (good + bad), False) if n < 100 else (bad, n / (good + bad), True))
    k = np.arange(small + 1)
    probs = np.array([math.comb(small, int(i)) * share ** int(i) * (1 - share) ** int(small - i) for i in k])
    drawn = n - x if flip else x
    stat, cells = _chi(np.bincount(drawn, minlength=small + 1), probs)
    assert stat < cells + 5 * math.sqrt(2 * cells) and len(logs) == len(xs)


def test_large_draws_agree_with_numpy(monkeypatch):
    args = [np.full(30000, v) for v in (3000, 5000, 2000)]
    want = np.random.default_rng(4).hypergeometric(*args)
    monkeypatch.setattr(mc, "_NUMPY_MOST", 0)
    got = mc.hypergeometric(np.random.default_rng(5), *args)
    assert abs(got.mean() - want.mean()) < 5 * want.std() / math.sqrt(15000)
    assert abs(got.std() / want.std() - 1) < 0.03


def test_log_factorial_ratio_is_precise():
    for x, m in ((10**12 + 5, 10**12), (300, 200), (10, 3), (1000, 20)):
        want = sum(math.log(k) for k in range(m + 1, x + 1)) if x - m < 2000 else None
        assert math.isclose(float(mc.log_factorial_ratio(x, m)), want, rel_tol=1e-12)


def test_huge_counts_through_all_tests(spark):
    n = 5 * 10**9
    rows = [("A", "Lost", n), ("A", "Won", n), ("B", "Lost", n), ("B", "Won", n + 40000), ("C", "Lost", 3), ("C", "Won", 2)]
    long = spark.createDataFrame(rows, "team string, deal_outcome string, n long")
    table = np.array([[n, n], [n, n + 40000], [3, 2]], float)
    e = table.sum(1)[:, None] * table.sum(0) / table.sum()
    want = ((table - e) ** 2 / e).sum()
    assert math.isclose(st.chi_square(long, "team", "deal_outcome").first().statistic, want, rel_tol=1e-6)
    r = st.chi_square_mc(spark, long, "team", "deal_outcome", replicates=400, seed=2).first()
    assert math.isclose(r.statistic, want, rel_tol=1e-6)
    q = math.exp(-want / 2)  # two degrees of freedom
    assert abs(r.p_value - q) < 4 * math.sqrt(q * (1 - q) / 400) + 0.02
    f = st.fisher_mc(spark, long, "team", "deal_outcome", replicates=400, seed=2).first()
    assert abs(f.p_value - q) < 4 * math.sqrt(q * (1 - q) / 400) + 0.03
    # one degree of freedom: z = difference of shares over its deviation
    z = (n + 40000 - n) / 2 / math.sqrt(n / 4 * 2)
    p = st.fisher_mc(spark, long.where("team <> 'C'"), "team", "deal_outcome").first().p_value
    assert math.isclose(p, math.erfc(z / math.sqrt(2) / math.sqrt(2)), rel_tol=0.02)


def test_tables_of_many_rows_and_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F
    long = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("team"), F.explode(F.array(
        F.struct(F.lit("Lost").alias("deal_outcome"), (F.col("id") % 5 + 1).alias("n")),
        F.struct(F.lit("Won").alias("deal_outcome"), ((F.col("id") * 7) % 5 + 1).alias("n")))).alias("s")).select("team", "s.*")
    ps = []
    for size in (4096, 200):  # one block of rows, then a tree of fifteen
        monkeypatch.setattr(mc, "ROWS_PER_BLOCK", size)
        ps.append(st.chi_square_mc(spark, long, "team", "deal_outcome", replicates=600, seed=1).first().p_value)
    assert abs(ps[0] - ps[1]) < 6 * math.sqrt(0.25 / 600)


def test_spearman_with_a_hot_value(spark):
    from pyspark.sql import functions as F
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("a"),
                                  ((F.col("id") * 17) % 40).cast("double").alias("b"))
    pdf = df.toPandas().rank()
    assert math.isclose(st.spearman(df, "a", "b").first().rho, pdf["a"].corr(pdf["b"]), rel_tol=1e-9)


def test_spearman_ties_matches_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    data = [(float(x % 7), float((x * 3) % 5 + (x % 2))) for x in range(200)] + [(None, 1.0)]
    df = spark.createDataFrame(data, "a double, b double")
    ours = st.spearman(df, "a", "b").first()
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(df.dropna())
    ml = Correlation.corr(vec, "v", "spearman").first()[0].toArray()[0, 1]
    assert ours.n_pairs == 200
    assert math.isclose(ours.rho, ml, rel_tol=1e-9, abs_tol=1e-12)


def test_monte_carlo_independent_of_partitioning(spark):
    long = _table_3x2(spark)
    ps = {st.chi_square_mc(spark, long, "team", "deal_outcome", replicates=3000, seed=11,
                           partitions=k).first().p_value for k in (1, 4, 7)}
    fs = {st.fisher_mc(spark, long, "team", "deal_outcome", replicates=1500, seed=11,
                       partitions=k).first().p_value for k in (1, 3)}
    assert len(ps) == 1 and len(fs) == 1
