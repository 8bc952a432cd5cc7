"""Operators 6, 8 and 9, and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from conftest import SF_SMALL
from dealflow.llm import mixing, quality, queries, suffixtree
from llm_rows import empty, frame, odd  # noqa: F401

# -- op 8 -------------------------------------------------------------------


def measures(text):
    text = text or ""
    data = text.encode()
    words = data.split()
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for k, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            inside |= {k, k + 1, k + 2}
    lines = [x for x in data.split(b"\n") if x.split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(inside))


def test_op8_measures_and_verdicts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    wrong = 0
    for r in queries.QUERIES["op8_ngram_ratio"](spark, SF_SMALL).collect():
        want = measures(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
        if r.doc_id in labels and not r.base_failed:
            wrong += r.kept != bool(labels[r.doc_id].quality)
    assert wrong <= 1


def test_op8_score_against_numpy(spark):
    rows = [(k, f"alpha beta gamma {k} delta!! " * 12) for k in range(20)] + [(100 + k, f"| x{k} %%% | " * 30) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(10)] + [(100, 0, 0), (101, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    found = {k: f for (k, _), f in zip(rows, quality.Features()([t.encode().split() for _, t in rows]))}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for k, f in found.items():
        np.add.at(raw, f, 1)
        if k < 10:
            np.add.at(target, f, 1)
    weight = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(model.weight, weight)
    for r in quality.assess(docs, model).collect():
        assert math.isclose(r.score, weight[found[r.doc_id]].mean(), rel_tol=1e-9)
        assert r.base_failed or r.kept == (r.doc_id < 100)


def test_op8_odd_rows(spark, odd, empty):  # noqa: F811
    labels = spark.createDataFrame([(5, 1, None), (None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    out = quality.assess(odd, model)
    assert out.count() == odd.count() and out.where("doc_id = 1").first().n_words == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.assess(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_op8_fits_on_all_labels(spark):
    """Every trusted document counts: with all of them trusted the ratio is 1."""
    docs = spark.range(20_050).selectExpr("id as doc_id", "'some common words' as text")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert np.allclose(quality.fit(docs, labels).weight, 0, atol=1e-12)


def test_op8_scores_once_as_twice(spark, odd):  # noqa: F811
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "quality", "toxic")
    labels = labels.unionByName(labels.where("doc_id % 3 = 0"))  # repeated labels
    once = quality.fit_and_assess(docs, labels).collect()
    twice = quality.assess(docs, quality.fit(docs, labels)).collect()
    assert sorted(map(str, once)) == sorted(map(str, twice))
    assert {r.kept for r in once} == {True, False}


# -- op 6 -------------------------------------------------------------------

def test_rake_meets_margins(spark):
    rng = np.random.default_rng(1)
    mass = rng.integers(1, 1000, (6, 3, 4))
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", k, int(mass[i, j, k])) for i in range(6) for j in range(3) for k in range(4)],
                                  "source string, lang string, topic int, mass long")
    targets = mixing.power_targets(cells, {"source": 0.5, "lang": 0.0, "topic": 1.0})
    got = mixing.rake(cells, targets).toPandas()
    want = mass.astype(float)
    goals = [mass.sum((1, 2)) ** 0.5, np.ones(3), mass.sum((0, 1)).astype(float)]
    goals = [g / g.sum() for g in goals]
    for _ in range(200):
        for axis, g in enumerate(goals):
            shape = [1, 1, 1]
            shape[axis] = -1
            want *= (g / want.sum(tuple(a for a in range(3) if a != axis))).reshape(shape)
    assert np.isclose(got["weight"].sum(), 1, atol=1e-6)
    for r in got.itertuples():
        assert math.isclose(r.weight, want[int(r.source[1]), int(r.lang[1]), r.topic], rel_tol=0.01)


def test_sampling_meets_the_budget(spark):
    rows = [(k, " ".join(f"word{(k * 31 + n * 7) % 400}x" for n in range(20 + k % 50)), "en" if k % 3 else None, f"s{k % 5 if k % 2 else 0}")
            for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, token_share=0.4).toPandas()
    assert len(out) == 3000
    total = out["__tokens"].sum()
    expected = (out["__tokens"] * out["__probability"]).sum()
    assert math.isclose(expected, 0.4 * total, rel_tol=1e-6)
    assert abs(out.loc[out["__drawn"], "__tokens"].sum() / total - 0.4) < 0.05
    again = mixing.mix(docs.repartition(7), token_share=0.4).where("__drawn").select("doc_id").toPandas()
    assert set(again["doc_id"]) == set(out.loc[out["__drawn"], "doc_id"])
    full = mixing.mix(docs, token_share=1.0).toPandas()
    assert np.allclose(full["__probability"], 1)


def test_op6_odd_rows(spark, odd, empty):  # noqa: F811
    out = mixing.mix(odd)
    assert out.count() == odd.count()
    assert out.where("__tokens = 0").where("__probability = 1 and __drawn").count() == 3
    assert mixing.mix(empty).count() == 0


def test_op6_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = queries.QUERIES["op6_raking"](spark, SF_SMALL).toPandas()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert got.set_index("doc_id")["n_tokens"].to_dict() == words


# -- op 9 -------------------------------------------------------------------

def held_out(key):
    return zlib.crc32(str(key).encode()) % 10 == 0


def test_op9_base_and_better_scores(spark):
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [b"\n"]
            for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    count = Counter(w for k, ws in docs.items() if not held_out(k) for w in ws)
    total, kinds = sum(count.values()), len(count)
    rows = queries.QUERIES["op9_suffix_tree"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = docs[r.doc_id]
        want = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            held_out(r.doc_id), len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def brute_scores(rows):
    """The same tree in plain dictionaries."""
    docs = [(k, (t or "").encode().lower().split() + [b"\n"]) for k, t in rows]
    train = [ws for k, ws in docs if not held_out(k)]
    n = [Counter(), Counter(), Counter()]
    for ws in train:
        for i, w in enumerate(ws):
            for d in range(3):
                if i >= d:
                    n[d][tuple(ws[i - d:i]), w] += 1
    tokens = sum(n[0].values())
    one = {w: c for ((), w), c in n[0].items()}
    unseen = (sum(c == 1 for c in one.values()) + 0.5) / (tokens + 1)
    least = max(1.0, suffixtree.MIN_SHARE * tokens)

    def root(w):
        return (1 - unseen) * one[w] / tokens if w in one else unseen

    total, kinds = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    for d in (1, 2):
        for (c, w), k in n[d].items():
            total[d][c] += k
            kinds[d][c] += 1
    pairs = Counter(p for ws in train for p in zip(ws, ws[1:]) if p[1] != b"\n")
    candidates = {(w,) for w, c in one.items() if c >= least and w != b"\n"}
    candidates |= {p for p, c in pairs.items() if c >= least and (p[0],) in candidates and (p[1],) in candidates}
    kept = set()

    def prob(c, w, out=0):
        d = len(c)
        if d == 0:
            return root(w)
        up = prob(suffix(c), w)
        k, t, pull = n[d][c, w] - out, total[d][c] - out, max(kinds[d][c], 1)
        return (max(k, 0) + pull * up) / (max(t, 0) + pull)

    def suffix(c):
        c = c[1:]
        return c if not c or c in kept else suffix(c)

    for d in (1, 2):
        gain = Counter()
        for (c, w), k in n[d].items():
            if c in candidates:
                gain[c] += k * (math.log(prob(c, w, 1)) - math.log(prob(suffix(c), w)))
        kept |= {c for c, g in gain.items() if g > suffixtree.MIN_GAIN}
    scores = {}
    for k, ws in docs:
        s = 0.0
        for i, w in enumerate(ws):
            c = next((tuple(ws[i - d:i]) for d in (2, 1) if i >= d and tuple(ws[i - d:i]) in kept), ())
            s += math.log10(prob(c, w))
        scores[k] = s
    return scores, kept


def test_op9_against_plain_tree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        a, b, ws = 0, 1, []
        for _ in range(60):  # the next word hangs on the last two, or the last, or none
            way = rng.random()
            c = (7 * a + 3 * b) % 12 if way < 0.5 else (5 * b + 1) % 12 if way < 0.9 else int(rng.integers(0, 400))
            a, b = b, c
            ws.append(f"w{b}")
        rows.append((k, " ".join(ws)))
    monkeypatch.setattr(suffixtree, "MIN_SHARE", 0.004)
    want, kept = brute_scores(rows)
    assert {len(c) for c in kept} == {1, 2}
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # one chunk: candidates as in one corpus
    got = {r.doc_id: r.score for r in suffixtree.score(df).collect()}
    for k, s in want.items():
        assert math.isclose(got[k], s, rel_tol=1e-5)


def plain_tree(rows, least, longest):
    """Scores and kept contexts with every count in one dictionary."""
    docs = [(k, t.encode().lower().split() + [b"\n"]) for k, t in rows]
    n, total, kinds = Counter(), Counter(), Counter()
    for k, ws in docs:
        for i, w in enumerate(ws):
            for d in range(min(i, longest) + 1):
                n[tuple(ws[i - d:i]), w] += not held_out(k)
    for (c, _), k in n.items():
        total[c] += k
        kinds[c] += k > 0
    once = sum(k == 1 for (c, _), k in n.items() if not c)
    unseen, kept = (once + 0.5) / (total[()] + 1), set()

    def prob(c, w, out=0):
        if not c:
            return (1 - unseen) * n[c, w] / total[()] if n[c, w] else unseen
        pull, up = max(kinds[c], 1), prob(suffix(c[1:]), w)
        return (max(n[c, w] - out, 0) + pull * up) / (max(total[c] - out, 0) + pull)

    def suffix(c):
        return c if not c or c in kept else suffix(c[1:])

    for d in range(1, longest + 1):
        gain = Counter()
        for (c, w), k in list(n.items()):
            if len(c) == d and total[c] >= least and k:
                gain[c] += k * (math.log(prob(c, w, 1)) - math.log(prob(suffix(c[1:]), w)))
        kept |= {c for c, g in gain.items() if g > suffixtree.MIN_GAIN}
    return {k: sum(math.log10(prob(suffix(tuple(ws[max(i - longest, 0):i])), w)) for i, w in enumerate(ws))
            for k, ws in docs}, kept, total


def test_op9_absolute_counts_longer_contexts_many_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(600):
        ws = [f"f{x}" for x in rng.integers(0, 3000, 40)]  # a corpus in which 60 occurrences are a small share
        if k % 6 == 0:  # the fourth word hangs on the first of four
            a = int(rng.integers(0, 2))
            ws[5:5] = [f"a{a}", "b", "c", f"d{a}"]
            ws[20:20] = [f"a{1 - a}", "b", "c", f"d{1 - a}"]
        rows.append((k, " ".join(ws)))
    want, kept, total = plain_tree(rows, suffixtree.MIN_COUNT, suffixtree.LONGEST)
    assert max(map(len, kept)) == 3 and min(total[c] for c in kept) < 0.005 * total[()]
    monkeypatch.setattr(suffixtree, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffixtree, "PART_ENTRIES", 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in suffixtree.score(df).collect()}
    assert len(got) == len(want)
    for k, s in want.items():
        assert math.isclose(got[k], s, rel_tol=1e-5)


def test_op9_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    text = [int(x) for x in np.repeat(rng.integers(0, 6, 900), 2)]  # what follows a word is often that word
    pairs, n = Counter(zip(text, text[1:])), Counter(text)
    p = {w: 0.98 * n[w] / len(text) for w in n}                     # 0.02 for words never seen
    halves = []
    for part in (0, 1):                                             # two chunks with half of the counts each
        keys = sorted((c, w) for c, w in pairs if (c + w) % 3 != part)
        share = [pairs[k] if (sum(k) % 3 == 2 - part * 2 or part == 0 and sum(k) % 3 == 1) else 0 for k in keys]
        cs = sorted({c for c, _ in keys})
        halves.append((keys, cs, suffixtree.squeeze(
            np.array(cs, "<u8"), np.array([sum(k[0] == c for k in keys) for c in cs], "<u4"),
            np.array([w for _, w in keys], "<u8"), np.array(share, "<u4"), np.array([p[w] for _, w in keys], "<f4"))))
    totals, counts = {}, {}
    for (keys, cs, _), blob in zip(halves, suffixtree.judge_contexts([h[2] for h in halves], 1.0)):
        occurrences, pull, count = suffixtree.expand(blob, "<i8", "<i8", "<i8")
        totals.update(zip(cs, zip(occurrences.tolist(), pull.tolist())))
        counts.update(zip(keys, count.tolist()))
    assert counts and any(t for t, _ in totals.values())
    for c, (t, pull) in totals.items():
        if t:
            after = {w: k for (x, w), k in counts.items() if x == c}
            assert t == sum(after.values()) and pull == sum(k > 0 for k in after.values())
            own = sum((after.get(w, 0) + pull * p[w]) / (t + pull) for w in p)
            assert math.isclose(own + pull * 0.02 / (t + pull), 1)


def test_op9_numbers_of_words_and_counts_sent_back():
    hashes = np.array([[1, 1], [2, 2], [3, 3]], "<u8")
    blocks = [suffixtree.squeeze(hashes, np.array([1, 5, 0], "<u4")), suffixtree.squeeze(hashes[1:], np.array([2, 4], "<u4"))]
    got = [suffixtree.expand(x, "<i8", "<u8") for x in suffixtree.count_words(blocks, 3, 5)[0]]
    assert [g[0].tolist() for g in got] == [[1, 7, 4], [7, 4]]
    assert [g[1].tolist() for g in got] == [[13, 3, 8], [3, 8]]  # the commonest word of a part has its least number
    block = suffixtree.squeeze(np.array([9], "<u8"), np.array([2], "<u4"), np.array([3, 8], "<u8"),
                               np.array([60, 2], "<u4"), np.array([0.9, 0.1], "<f4"))
    for least, counts in ((0, [60, 2]), (50, [60, 0])):  # the context goes: only the next candidate's count is sent
        assert suffixtree.expand(suffixtree.judge_contexts([block], 1e9, least)[0], "<i8", "<i8", "<i8")[2].tolist() == counts


def test_op9_odd_rows_and_many_chunks(spark, odd, empty, monkeypatch):  # noqa: F811
    out = suffixtree.score(odd).toPandas()
    assert len(out) == odd.count() and out["score"].notna().all() and (out["score"] <= 0).all()
    assert out.loc[out["doc_id"].isna(), "held_out"].all()
    assert (out.loc[out["doc_id"].isin([1, 2, 3]), "n_tokens"] == 1).all()
    assert suffixtree.score(empty).count() == 0


# -- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark, odd):  # noqa: F811
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name != "bpe":
            assert out.columns == docs.columns
            before = docs
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
    good = {r.doc_id for r in quality.assess(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), quality.fit(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet"))).where("kept").collect()}
    assert kept["quality rules"] == good
    assert kept["secret scan"] == kept["near-dedup"] < kept["quality rules"]
    assert kept["bpe"] == kept["mixing"] < kept["secret scan"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_rows(spark, odd, empty, name):  # noqa: F811
    from pyspark.sql import functions as F
    stage = dict(corpus_pipeline.STAGES)[name]
    for df in (odd, empty):
        df = df.withColumn("n_chars", F.length("text").cast("long"))
        out = stage(spark, df, SF_SMALL)
        out.count()
        if name != "bpe":
            assert out.columns == df.columns
