"""Operators 4 and 7 against all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from conftest import SF_SMALL
from llm_rows import empty, odd  # noqa: F401
from dealflow.llm import hyperplanes, queries, setsketch
from dealflow.llm.common import components, whole_runs


def labels(nodes, pairs):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(k, shingle_set(t)) for k, t in rows]
    pairs = [(a, b) for (a, x), (b, y) in combinations(sets, 2)
             if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return labels({k for k, _ in sets}, pairs), {k: len(s) for k, s in sets}


def check(df, rows):
    root, size = brute(rows)
    got = df.collect()
    assert {r.doc_id for r in got} == set(root)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(500, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = labels({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op4_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    check(queries.QUERIES["op4_setsketch"](spark, SF_SMALL), [tuple(r) for r in docs])


def test_op4_family_of_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 8)  # many block pairs for one group
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
        rows.append((k, " ".join(words)))
    rows += [(k, " ".join(f"v{k}-{n}" for n in range(30))) for k in range(200, 220)]
    rows += [(300, "a b c d"), (301, "A b  c\nd"), (302, "a b c"), (303, "a b c d e f g h i"), (304, "a b c d e f g h j")]
    check(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_op4_one_passage_makes_no_group(spark, monkeypatch):
    """Texts that share a passage share bands, so ties of bands alone reach across the corpus."""
    members, confirmed = [], setsketch.confirmed
    monkeypatch.setattr(setsketch, "confirmed", lambda m: members.append(m.count()) or confirmed(m))
    passage = " ".join(f"p{k}" for k in range(18))
    rows = [(k, passage + " " + " ".join(f"u{k}-{n}" for n in range(16))) for k in range(300)]
    rows += [(400 + k, rows[k][1] + " end") for k in range(10)]
    check(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    assert 20 <= members[0] <= 60


def test_op4_bands_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "MOST_BLOCK_ROWS", 16)
    monkeypatch.setattr(setsketch, "FEW_ROWS", 4)
    rng = random.Random(5)
    rows = []
    for k in range(160):
        words = [f"w{k % 2}-{n}" for n in range(90)]
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
        rows.append((k * 7 % 160, " ".join(words)))
    check(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_whole_runs_cuts_where_keys_change():
    keys = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4, 5]
    for cuts in ([], [2], [3, 5], [1, 2, 7, 10], list(range(1, 11))):
        edges = [0, *cuts, len(keys)]
        batches = [pa.record_batch({"k": keys[a:b], "n": list(range(a, b))}) for a, b in zip(edges, edges[1:])]
        runs = [t["n"].to_pylist()[a:b] for t, c in whole_runs(iter(batches), ["k"]) for a, b in zip(c[:-1], c[1:])]
        assert runs == [[0, 1], [2, 3, 4, 5, 6], [7], [8, 9], [10]]


def test_likely_pairs_are_those_of_the_estimate():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 300).astype("<u8")
    sets = [np.unique(np.concatenate([base[rng.random(300) > rng.uniform(0, 0.4)],
                                      rng.integers(0, 1 << 62, rng.integers(0, 90)).astype("<u8")])) for _ in range(90)]
    regs, size = np.array([setsketch.registers(s) for s in sets]), np.array([len(s) for s in sets])
    est = setsketch.joint_estimate(regs, regs, size, size)
    found = setsketch.likely(regs, regs, size, size)
    assert (found == (est >= setsketch.FLOOR)).all() and 0.05 < found.mean() < 0.95
    true = np.array([[len(np.intersect1d(s, t)) / len(np.union1d(s, t)) for t in sets[:9]] for s in sets])
    assert np.abs(est[:, :9] - true).max() < 0.15


def test_op4_odd_rows(spark, odd, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(odd).collect()}
    assert (None, 1, None, True) in got and (1, 0, 1, True) in got and (2, 0, 2, True) in got
    assert setsketch.near_duplicates(odd).count() == odd.count()
    assert setsketch.near_duplicates(empty).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 62, 900).astype("<u8") for _ in range(2))
    common = rng.integers(0, 1 << 62, 2700).astype("<u8")
    one, two = np.concatenate([a, common]), np.concatenate([b, common])
    ra, rb = setsketch.registers(one), setsketch.registers(two)
    assert (setsketch.registers(np.unique(np.concatenate([one, two]))) == np.maximum(ra, rb)).all()
    est = setsketch.joint_estimate(ra[None], rb[None], np.array([3600]), np.array([3600]))[0, 0]
    assert abs(est - 2700 / 4500) < 0.12


def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        center = rng.standard_normal(32)
        rows += [center + rng.standard_normal(32) * rng.uniform(0, 0.5) for _ in range(20)]
    rows += [rows[3]] * 5 + [rows[7] * 2.0]
    return [(k, v.tolist()) for k, v in enumerate(rows)]


def test_op7_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hyperplanes, "BLOCK_ROWS", 7)
    rows = vectors()
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    want = labels(range(len(rows)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    got = {r.vec_id: r for r in hyperplanes.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = sum(r.n_links for r in got.values())
    true = int(near.sum()) - len(rows)
    assert 0.99 * true <= links <= true
    assert sum(got[k].component_id != want[k] for k in got) <= 1


def test_op7_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]),
            (7, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (10, [1e300, 1e300]),
            (11, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "2 as links")
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in hyperplanes.near_vectors(df).collect())
    assert got == [(-1, 0, None, True), *((k, 0, k, True) for k in range(1, 7)), (7, 3, 7, True), (8, 3, 7, False),
                   (8, 3, 7, False), (9, 0, 9, True), (10, 3, 7, False), (11, 0, 11, True)]
    none = hyperplanes.near_vectors(df.limit(0))
    assert none.count() == 0


def test_tables_for():
    assert hyperplanes.tables_for(12, 0.9, 3e-4) <= hyperplanes.TABLES
