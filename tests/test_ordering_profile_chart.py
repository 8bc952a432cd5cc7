import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dealflow.operators import chartdata as cd
from dealflow.operators import profile as pr
from dealflow.operators.aggregates import null_profile
from dealflow.operators.ordering import mid_ranks_of, read_order_id, row_id
from dealflow.sources.io import remove_empty


def test_row_id_dense_matches_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select(((F.col("id") * 7919) % 5003).alias("k"))
    ours = row_id(df.repartition(5), ["k"], "rid")
    ref = df.select("k", F.row_number().over(Window.orderBy("k")).alias("rid"))
    assert sorted(map(tuple, ours.collect())) == sorted((r.rid, r.k) for r in ref.collect())


def test_read_order_id_counts_without_sorting(spark):
    df = spark.range(0, 1000, numPartitions=6).where("id % 3 <> 0").select(F.col("id").alias("k"))
    got = [(r.rid, r.k) for r in read_order_id(df, "rid").orderBy("rid").collect()]
    assert got == [(i + 1, k) for i, k in enumerate(k for k in range(1000) if k % 3)]


def test_mid_ranks_weighted(spark):
    df = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "x int, n long")
    ranks, = mid_ranks_of(df, ["x"], ["rank"], weight="n")
    assert {r.x: r["rank"] for r in ranks.collect()} == {10.0: 1.0, 20.0: 2.5, 30.0: 5.0}


def test_remove_empty_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, None, None), (3, None, "c")],
                               "a int, b string, c string")
    out = remove_empty(df)
    assert out.columns == ["a", "c"] and out.count() == 2
    ids = row_id(out, ["a"], "id").collect()
    assert [r.id for r in sorted(ids, key=lambda r: r.a)] == [1, 2]


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), None), (None, "y")], "p double, s string")
    got = {r.column: r.n_missing for r in null_profile(df).collect()}
    assert got == {"p": 2, "s": 1}


def test_profiles(spark):
    df = spark.createDataFrame(
        [(1, "aa", True), (2, "aa", False), (3, "bb", None), (4, None, True)],
        "n long, s string, b boolean")
    num = pr.profile_numeric(df).first()
    assert (num.n_missing, num.p50, num.p0, num.p100) == (0, 2.5, 1.0, 4.0)
    cat = pr.profile_categorical(df).first()
    assert (cat.n_missing, cat.n_unique, [tuple(t) for t in cat.top_counts]) == (1, 2, [("aa", 2), ("bb", 1)])
    b = pr.profile_boolean(df).first()
    assert (b.n_missing, b.n_true, b.n_false) == (1, 2, 1)


def test_histogram_rejects_constant_and_counts_all(spark):
    const = spark.createDataFrame([(5,), (5,)], "x int")
    with pytest.raises(ValueError):
        cd.histogram(const, "x", 10)
    df = spark.range(0, 1000).select((F.col("id") % 97).alias("x"))
    h = cd.histogram(df, "x", 10).collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 1000
    assert h[0].xmin < 0 < h[0].xmax
    off = spark.range(10, 308).select(F.col("id").alias("x"))  # width 3: edges at odd multiples of 1.5
    h = sorted(cd.histogram(off, "x", 100).collect(), key=lambda r: r.bin)
    assert (h[0].xmin, len(h), sum(r["count"] for r in h)) == (7.5, 100, 298)


def test_boxplot_whisker_stops_before_outlier(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    s = cd.boxplot_stats(df, ["g"], "v").first()
    assert s.ymax == 5.0 and s.n_outliers == 1 and s.middle == 3.5
    out = cd.boxplot_outliers(df, ["g"], "v").collect()
    assert [r.v for r in out] == [100.0]


def test_grouped_quantiles_both_paths(spark):
    from dealflow.operators.ordering import grouped_quantiles
    random.seed(5)
    rows = [(random.choice(["a", "b", None]),
             float(random.randint(0, 300)) if random.random() > 0.05 else None)
            for _ in range(3000)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs, names = [0, 0.25, 0.5, 0.75, 1], ["q0", "q1", "q2", "q3", "q4"]
    ref = {r.g: list(r.p) for r in df.groupBy("g").agg(F.percentile("v", probs).alias("p")).collect()}
    for bound in (10**6, 5):  # built-in percentile path, then distributed rank selection
        got = {r.g: [r[n] for n in names]
               for r in grouped_quantiles(df, ["g"], "v", probs, names, max_values=bound).collect()}
        assert set(got) == set(ref)
        for k in ref:
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], ref[k])), (bound, k)


def test_row_id_spreads_a_hot_key(spark):
    hot = spark.range(0, 20000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")  # keep the range partitions visible at this tiny size
    try:
        ids = row_id(hot, ["k"], "rid")
        per_part = ids.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(key, old)
    assert ids.agg(F.min("rid"), F.max("rid"), F.countDistinct("rid")).first() == (1, 20000, 20000)
    assert max(r["count"] for r in per_part) < 20000 / 3  # the 6667 rows of k=7 are split
    order = [r.k for r in ids.orderBy("rid").collect()]
    assert order == sorted(order)


def test_mid_ranks_of_several_columns(spark):
    random.seed(9)
    rows = [(random.randint(0, 20), float(random.randint(0, 5)) if random.random() > 0.1 else None)
            for _ in range(400)]
    df = spark.createDataFrame(rows, "a int, b double")
    for c, ranks in zip("ab", mid_ranks_of(df, ["a", "b"], ["ra", "rb"])):
        values = sorted(float(v) for v in (r[0 if c == "a" else 1] for r in rows) if v is not None)
        want = {v: (values.index(v) + 1 + len(values) - values[::-1].index(v)) / 2 for v in values}
        assert {r[0]: r[1] for r in ranks.collect()} == want
