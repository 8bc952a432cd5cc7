"""Joins with hot keys, running sums over many partitions, radix selection,
permutation tests: the paths that large inputs take."""

import io
import contextlib
import hashlib
import math
import random
import struct
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dealflow.operators import joins, ordering
from dealflow.operators.permutation import log_factorial, permutation_test


def explained(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture
def shuffled(spark):
    """Nothing broadcast by Spark itself, no runtime splitting of partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                          "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("-1", "false", "16")):
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("hot", ["owner 7", None])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_owner_is_split(shuffled, hot, how):
    n = 60_000
    key = F.when(F.col("id") % 2 == 0, F.lit(hot)).otherwise(F.concat(F.lit("owner "), F.col("id") % 4001))
    left = shuffled.range(n).repartition(5).select("id", key.alias("owner"))
    right = shuffled.range(3000).select(F.concat(F.lit("owner "), "id").alias("rep"), (F.col("id") % 9).alias("team"))
    right = right.unionByName(shuffled.createDataFrame([(None, 100), ("owner 7", 101)], "rep string, team long"))
    out = joins.lookup_join(left, right, "owner", "rep", how, max_broadcast_rows=0)
    assert out.columns == ["id", "owner", "team"]
    sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    plain = left.join(F.broadcast(right), left.owner.eqNullSafe(right.rep), how).select("id", "owner", "team")
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_are_found_and_others_are_not(shuffled):
    df = shuffled.range(40_000).select(F.when(F.col("id") % 3 == 0, None).when(
        F.col("id") % 5 == 0, 1).otherwise(F.col("id")).alias("k"))
    found = dict(joins.hot_keys(df, F.xxhash64("k"), 16))
    want = {r[0] for r in df.where("k is null or k = 1").select(F.xxhash64("k")).distinct().collect()}
    assert set(found) == want and all(n > 8 for n in found.values())
    even = shuffled.range(40_000)
    left, right, salt = joins.split_hot_keys(even, even.withColumnRenamed("id", "r"), ["id"], ["r"])
    assert salt is None and left is even
    none = even.where("id < 0")
    assert joins.hot_keys(none, F.xxhash64("id"), 16) == []


def test_equal_rows_of_a_hot_key_spread(shuffled):
    left = shuffled.range(40_000, numPartitions=40).select(F.lit("x").alias("k"))
    right = shuffled.createDataFrame([("x", 1), ("y", 2)], "r string, v int")
    out = joins.lookup_join(left, right, "k", "r", max_broadcast_rows=0)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) >= 10


def test_running_sums_do_not_grow_the_plan(spark):
    plans = {}
    for parts in (5, 5000):
        df = spark.range(20_000, numPartitions=parts).withColumn("v", F.col("id") * 3)
        out = ordering.read_order_id(df, "row")
        plans[parts] = len(explained(out))
        got = out.agg(F.sum(F.abs(F.col("row") - F.col("id") - 1)), F.count("row")).first()
        assert tuple(got) == (0, 20_000)
    assert plans[5000] < plans[5] + 200


def test_prefix_table_blocks_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PREFIX_BLOCK", 4)
    rng = random.Random(3)
    rows = [(k, p, rng.randint(0, 9)) for k in ("a", None, "b") for p in range(30) if rng.random() < 0.8]
    got = {(r.k, r.p): r._ord_off for r in ordering.prefix_table(
        spark.createDataFrame(rows, "k string, p int, w long"), "p", "w", ["k"]).collect()}
    assert got == {(k, p): sum(w for k2, p2, w in rows if k2 == k and p2 < p) for k, p, _ in rows}


def test_keyed_prefix_over_keys(spark):
    rows = [(k, float(v), v % 4 + 1) for k in ("a", "b", None) for v in range(57)]
    df = spark.createDataFrame(rows, "k string, v double, w long").repartition(9)
    got = {(r.k, r.v): r.c for r in ordering.keyed_prefix(df, "k", "v", "w", "c").collect()}
    assert got == {(k, v): sum(w2 for k2, v2, w2 in rows if k2 == k and v2 < v) for k, v, _ in rows}


def doubles(rng, n):
    return [v for v in (struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(n)) if v == v]


def test_order_key_is_the_bit_pattern(spark):
    rng = random.Random(1)
    vals = doubles(rng, 2000) + [0.0, -0.0, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), math.nextafter(4, 0), 5e-324,
                                 -5e-324, 2.0 ** -1022, math.nextafter(2.0 ** -1022, 0), 1.7976931348623157e308,
                                 math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for r in df.select("v", ordering.order_key(F.col("v")).alias("k")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (-bits if r.v < 0 else bits)
    nan = spark.range(1).select(ordering.order_key(F.lit(float("nan"))).alias("k"), ordering.order_key(
        F.lit(math.inf)).alias("i")).first()
    assert nan.k > nan.i


@pytest.mark.parametrize("bits", [3, 12])
def test_radix_selection_equals_percentile(spark, monkeypatch, bits):
    monkeypatch.setattr(ordering, "RADIX_BITS", bits)
    rng = random.Random(bits)
    wide = 25 if bits == 3 else 400
    rows = [("i", float(rng.randint(-6, 6))) for _ in range(300)] + [(None, rng.choice([1.5, 2.5])) for _ in range(11)]
    rows += [("one", 7.0), ("w", math.inf), *[("w", v) for v in doubles(rng, wide) if abs(v) < 1e200]]
    if bits == 3:
        rows = [(g, v if g != "w" else float(round(v % 97))) for g, v in rows if v != math.inf]
    df = spark.createDataFrame(rows + [("i", None)], "g string, v double").repartition(4)
    probs, names = [0.0, 0.25, 0.5, 0.9, 1.0], list("abcde")
    slow = {r.g: tuple(r)[1:] for r in ordering.grouped_quantiles(df, ["g"], "v", probs, names, 0, "n").collect()}
    fast = {r.g: tuple(r)[1:] for r in ordering.grouped_quantiles(df, ["g"], "v", probs, names, None, "n").collect()}
    assert slow.keys() == fast.keys()
    for g in fast:
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(slow[g], fast[g])), g


def test_log_factorial(spark):
    xs = [0, 1, 2, 5, 20, 1000, 123456, 10 ** 9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x long").select(log_factorial(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert math.isclose(g, math.lgamma(x + 1), rel_tol=1e-13, abs_tol=1e-12)


def plain_permutation(rows, replicates, seed, kind):
    """The same deal in plain Python: (extreme replicates, observed statistic)."""
    labels = Counter(label for _, label, _ in rows)
    groups = Counter(g for g, _, _ in rows)

    def statistic(pairs):
        x = Counter(pairs)
        if kind == "fisher":
            return sum(math.lgamma(x[g, v] + 1) for g in groups for v in labels)
        e = {(g, v): groups[g] * labels[v] / len(rows) for g in groups for v in labels}
        return sum((x[c] - e[c]) ** 2 / e[c] for c in e)
    seen = statistic([(g, v) for g, v, _ in rows])
    hits = 0
    for r in range(replicates):
        def key(i):
            h = hashlib.md5(f"{seed}:{r // 2}:{i}".encode()).hexdigest()
            return h[16 * (r % 2):16 * (r % 2) + 16], str(i)
        dealt = [v for v in sorted(labels) for _ in range(labels[v])]
        order = sorted(rows, key=lambda t: key(t[2]))
        hits += statistic([(g, v) for (g, _, _), v in zip(order, dealt)]) >= seen - 1e-7
    return hits, seen


@pytest.mark.parametrize("kind", ["chisq", "fisher"])
@pytest.mark.parametrize("labels", [("Lost", "Won"), ("a", "b", "c")])
def test_permutation_equals_plain_deal(spark, monkeypatch, kind, labels):
    from dealflow.operators import permutation
    rng = random.Random(len(labels))
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice(labels), i) for i in range(400)]
    df = spark.createDataFrame(rows + [("x", None, 5000)], "team string, outcome string, id long")
    hits, seen = plain_permutation(rows, 31, 9, kind)
    for bounds in ((1 << 21, 1 << 28), (1, 1 << 28), (1, 2)):  # 16, 256 and 4096 buckets
        monkeypatch.setattr(permutation, "_BUCKETS", bounds)
        r = permutation_test(df, "team", "outcome", kind, replicates=31, seed=9).first()
        assert r.n_extreme == hits and math.isclose(r.statistic, seen, rel_tol=1e-9)
        assert r.p_value == (hits + 1) / 32 and r.df == 2 * (len(labels) - 1) and r.replicates == 31


def test_permutation_hashes_rows_once(spark, monkeypatch):
    """One pass keeps the hashes of a few rows near a label's end and deals all replicates."""
    from dealflow.operators import permutation
    passes, counted = [], permutation._counted
    monkeypatch.setattr(permutation, "_counted", lambda *a: passes.append(counted(*a)) or passes[-1])
    df = spark.range(40_000).selectExpr("concat('t', id % 3) as team", "if(id % 2 = 0, 'Won', 'Lost') as outcome", "id")
    permutation_test(df, "team", "outcome", replicates=4, seed=3).collect()
    assert len(passes) == 1
    assert passes[0].count() < 4 * 40_000 * 0.06


@pytest.mark.parametrize("reach", [1e-4, 0.5])
def test_permutation_widens_missed_windows(spark, monkeypatch, reach):
    from dealflow.operators import permutation
    rng = random.Random(7)
    rows = [(rng.choice("xyz"), rng.choice(["a", "b", "c"]), i) for i in range(3000)]
    hits, _ = plain_permutation(rows, 15, 4, "chisq")
    monkeypatch.setattr(permutation, "REACH", reach)
    df = spark.createDataFrame(rows, "team string, outcome string, id long")
    assert permutation_test(df, "team", "outcome", replicates=15, seed=4).first().n_extreme == hits


def test_permutation_of_shared_ids(spark):
    rng = random.Random(8)
    rows = [(rng.choice("xyz"), rng.choice(["a", "b"]), i // 100) for i in range(900)]
    hits, _ = plain_permutation(sorted(rows), 15, 4, "chisq")  # equal ids in the order of their rows
    df = spark.createDataFrame(rows, "team string, outcome string, id long")
    assert permutation_test(df, "team", "outcome", replicates=15, seed=4).first().n_extreme == hits


def plain_draws(rows, turns, edges, replicates, seed):
    """The draws of (row, id) pairs by hashlib, counted."""
    out = Counter()
    for (row, i), t, half in ((x, t, h) for x in rows for t in turns for h in (0, 1) if 2 * t + h < replicates):
        text = ":".join([str(seed), str(t), *([] if i is None else [i])])
        k = int(hashlib.md5(text.encode()).hexdigest()[16 * half:16 * half + 16], 16)
        z = sum(e is not None and k >> 32 >= e for e in edges)
        out[(2 * t + half, z, *((k - (1 << 63), i) if z % 2 else (None, None)), row)] += 1
    return out


@pytest.mark.parametrize("counts, once, most", [(1 << 22, 1 << 15, 1 << 18), (20, 64, 50), (1, 1, 1)])
def test_draws_are_those_of_plain_md5(monkeypatch, counts, once, most):
    """Also of null, empty, long and non-ASCII ids, null groups and one half of a hash."""
    from dealflow.operators import keyedhash
    for name, value in (("MOST_COUNTS", counts), ("AT_ONCE", once), ("MOST_ROWS", most)):
        monkeypatch.setattr(keyedhash, name, value)
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None, "z"]), rng.choice([str(k), None, "", "a" * 60 + str(k), f"é{k}"]))
            for k in range(150)]
    batches = [pa.record_batch({"_row": pa.array([g for g, _ in rows[k:k + 40]], pa.string()),
                                "_id": pa.array([i for _, i in rows[k:k + 40]], pa.string())}) for k in range(0, 150, 40)]
    for turns, replicates in ((range(13), 25), ([3, 9, 10, 11, 120], 300)):
        for edges in ([1 << 28, 1 << 30], [0, 1 << 29, 1 << 31, None]):
            got = Counter()
            for b in keyedhash.draws(iter(batches), turns, edges, replicates, 7):
                for r in b.to_pylist():
                    got[r["_r"], r["_z"], r["_k"], r["_id"], r["_row"]] += r["_n"]
            assert got == plain_draws(rows, turns, edges, replicates, 7)


@pytest.mark.parametrize("name, replicates", [("chi_square_mc", 10000), ("fisher_mc", 2000)])
def test_queries_deal_all_replicates(spark, name, replicates):
    """As many as in the original analysis, by no parameter of the query."""
    import __spark_entry__ as entry
    r = entry.queries()[name](spark, SF_SMALL).first()
    assert r.replicates == replicates and r.p_value == round((r.n_extreme + 1) / (replicates + 1), 6)


def test_permutation_needs_two_by_two(spark):
    df = spark.createDataFrame([("x", "Won", 1), ("y", "Won", 2)], "team string, outcome string, id long")
    for bad in (df, df.where("id < 0")):
        with pytest.raises(ValueError):
            permutation_test(bad, "team", "outcome", replicates=5)


def test_top_values_of_many_columns(spark):
    from dealflow.operators.profile import profile_categorical
    rows = [tuple(str((k * (c % 7 + 1)) % (c % 5 + 2)) if k % 9 else None for c in range(300)) for k in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"c{c} string" for c in range(300)))
    steps = {}
    for n in (3, 300):
        out = profile_categorical(df.select([f"c{c}" for c in range(n)]))
        steps[n] = explained(out).count("Exchange"), explained(out).count("Window")
    assert steps[3] == steps[300]
    for r in out.collect():
        seen = Counter(x[int(r.skim_variable[1:])] for x in rows)
        missing = seen.pop(None)
        want = sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))
        assert (r.n_missing, r.n_unique) == (missing, len(want))
        assert [(t.value, t.n) for t in r.top_counts] == want[:4]


def test_pivot_by_data(spark, monkeypatch):
    from dealflow.operators import aggregates
    rows = [("x", "b", 5, 2), ("x", "a", 6, 3), ("y", "a", 7, 1), (None, "c", 8, 0), ("y", None, 9, 0)]
    df = spark.createDataFrame(rows, "team string, kind string, n long, first long")
    wide, values = aggregates.pivot_by_data(df, "team", "kind", "n", "first", "n_")
    assert values == ["c", "a", "b"] and wide.columns == ["team", "n_c", "n_a", "n_b"]
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(
        [("x", None, 6, 5), ("y", None, 7, None), (None, 8, None, None)], key=str)
    monkeypatch.setattr(aggregates, "MOST_PIVOT_COLUMNS", 2)
    with pytest.raises(ValueError):
        aggregates.pivot_by_data(df, "team", "kind", "n", "first")
