"""Operators 11, 12 and 13 against plain Python and the tiktoken library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from conftest import SF_SMALL
from llm_rows import empty, frame, odd  # noqa: F401
from dealflow.llm import bytebpe, fim, periods, queries


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def documents(spark, path=SF_SMALL):
    return spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()


# ---- fill in the middle

def plain_units(text: str, unit: str) -> list[str]:
    if unit == "characters":
        return list(text)
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return [text[a if k else 0:b] for k, (a, b) in enumerate(zip(at, [*at[1:], len(text)]))]


def plain_fim(key, text, unit="characters"):
    text = text or ""
    us = plain_units(text, unit)
    digest = sha(f"1:{'' if key is None else key}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(us) + 1) for x in h[:2])
    p, m, s = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
    if not us or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return key, len(us), "plain", None, None, text
    spm = h[3] % 100 < 20
    made = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return key, len(us), "spm" if spm else "psm", a, b - a, made


def least_first(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_op11_whole_table(spark):
    got = {tuple(r) for r in queries.QUERIES["op11_fill_in_middle"](spark, SF_SMALL).collect()}
    want = set()
    for r in documents(spark):
        key, n, form, p, m, made = plain_fim(r.doc_id, r.text)
        want.add((key, n, form, p, m, sha(made), sha(r.text or "")))
    assert got == want
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", list(fim.UNITS))
def test_op11_units_odd_rows_and_way_back(spark, odd, empty, unit):
    marked = frame(spark, [(k, f"{'<' * (k % 3)}P>é漢 a<b\nS>{k}\n<" + "<M>" * (k % 7 == 0), "en", "a")
                           for k in range(60)])
    df = odd.unionByName(marked)
    made = fim.transform(df, unit=unit)
    got = least_first(tuple(r) for r in made.collect())
    assert got == least_first(plain_fim(r.doc_id, r.text, unit) for r in df.collect())
    from pyspark.sql import functions as F
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")))
    assert least_first(map(tuple, back.collect())) == least_first((r.doc_id, r.text or "") for r in df.collect())
    assert fim.transform(empty, unit=unit).count() == 0


@pytest.mark.parametrize("block", [64, 128, 1 << 20])
def test_op11_matrix_in_blocks(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = random.Random(block)
    texts = ["", " ", "\n\n", "a\n"] + ["".join(rng.choice("ab \n\té漢🙂.") for _ in range(rng.randint(0, 60)))
                                       for _ in range(120)]
    raw = [t.encode() for t in texts]
    end = np.cumsum([len(r) for r in raw])
    start = end - [len(r) for r in raw]
    index = fim.ClassMatrix(b"".join(raw), start)
    for unit in fim.UNITS:
        us = [plain_units(t, unit) for t in texts]
        assert index.units(unit, start, end).tolist() == list(map(len, us))
        k = np.array([rng.randint(0, len(u)) for u in us])
        cut = index.cut(unit, start, end, k) - start
        assert [r[:c].decode() for r, c in zip(raw, cut)] == ["".join(u[:n]) for u, n in zip(us, k)]


# ---- periodic runs

def plain_runs(words, least=12):
    """Every stretch by its definition: (start, length, period) by start, period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)  # a smaller period came first
            i = j + 1
    return sorted(((s, long, q) for (s, long), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_report(key, text, least=12):
    words = (text or "").encode().split()
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
    runs = plain_runs(words, least)
    drop = {i for s, long, q in runs for i in range(s + q, s + long)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_op12_whole_table(spark):
    got = {tuple(r) for r in queries.QUERIES["op12_synchronising_runs"](spark, SF_SMALL).collect()}
    short = [r for r in documents(spark) if len((r.text or "").split()) <= 3000]
    want = {plain_report(r.doc_id, r.text) for r in short}
    assert len(short) > 150 and want <= got and len(got) == len(documents(spark))
    assert any(w[1] > 1 for w in want)


def hard_words(rng):
    """Words with few values and much repetition, by several rules."""
    kind, n = rng.randrange(9), rng.randint(1, 220)
    root = [rng.randint(0, 1) for _ in range(rng.randint(1, 5))]
    out = [rng.randint(0, 1)]
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind == 1:
        return [bin(i).count("1") % 2 for i in range(n)]
    if kind == 2:  # Fibonacci words
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    while len(out) < n:
        if kind == 3:    # pieces of one period in other phases: runs between two regions
            out += (root * 70)[rng.randrange(len(root)):][:rng.randint(1, 60)]
        elif kind == 4:  # blocks repeated some times
            out += [rng.randint(0, 2) for _ in range(rng.randint(1, 12))] * rng.randint(1, 8)
        elif kind == 5:  # the end repeated
            out += out[-rng.randint(1, len(out)):]
        elif kind == 6:
            out += ([0] * rng.randint(1, 40) + [1]) * rng.randint(1, 5)
        elif kind == 7:
            out += [0]
        else:
            out += [rng.randint(0, 40)]
    return out[:400]


@pytest.mark.parametrize("least", [12, 2])
def test_op12_hard_words(least):
    rng = random.Random(least)
    for _ in range(25):
        texts = [hard_words(rng) for _ in range(20)]
        flat = np.array([x for k, w in enumerate(texts) for x in [*w, -1 - k]])
        size = np.array([len(w) + 1 for w in texts])
        got, start = periods.runs_of(flat, size, least), 0
        for w, n in zip(texts, size.tolist()):
            own = [(s - start, e - s, q) for s, e, q in got.tolist() if start <= s < start + n]
            assert own == plain_runs(w, least), w
            start += n


def test_op12_odd_rows(spark, odd, empty):
    texts = ["a " * 40, "x y " * 30 + "x", "one two " * 5 + "end", "q " * 11, "A a " * 6]
    df = odd.unionByName(frame(spark, [(100 + k, t, "en", "a") for k, t in enumerate(texts)]))
    found = periods.report(periods.find_runs(df))

    def want(r):  # without planting
        words = (r.text or "").encode().split()
        if len(words) > 3000:  # LONG has 997 lines of three words before it starts again, with other numbers
            return None
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        return r.doc_id, len(runs), *best
    plain = [w for w in map(want, df.collect()) if w]
    got = [tuple(r)[:5] for r in found.collect()]
    assert len(got) == df.count()
    for w in plain:
        assert got.count(w) == plain.count(w)
    assert periods.find_runs(empty).count() == 0


# ---- byte-level BPE by merge replay

@pytest.fixture(scope="module")
def ranks():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


def library(path):
    import public_tokenizers
    tokens = bytebpe.read_ranks(path)
    return tokens, tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                     mergeable_ranks={t: k for k, t in enumerate(tokens)})


def test_op13_whole_table(spark, ranks):
    _, lib = library(ranks)
    got = {tuple(r) for r in queries.QUERIES["op13_byte_bpe_replay"](spark, SF_SMALL).collect()}
    want = set()
    for r in documents(spark):
        ids = lib.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode_bytes(ids))))
    assert got == want


def random_texts():
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcdeth ingo 'sT.,1٣é́漢🙂 \x1c\x85\xa0\n\t\r<|endoftext|>İΣß²½'re'll 　ª")
                     for _ in range(50)) for _ in range(600)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2ff), rng.randint(0, 0xd7ff), rng.randint(0xe000, 0x10ffff),
                                      rng.randint(0x10000, 0x1ffff), 32, 10])) for _ in range(40)) for _ in range(600)]
    return texts + ["", " ", "  ", "\n\n a", "a ", " a", "a" * 5000, "ab" * 3000, "aaa  \n b " * 40]


def test_op13_random_texts(monkeypatch, ranks):
    import public_tokenizers
    tokens, lib = library(ranks)
    texts = random_texts()
    want = [lib.encode_ordinary(t) for t in texts]
    for window, most in ((1 << 20, 250_000), (70, 500)):
        monkeypatch.setattr(bytebpe, "WINDOW", window)
        monkeypatch.setattr(bytebpe, "MOST_WORDS", most)
        encoder = bytebpe.TextEncoder(tokens, public_tokenizers.PATTERN)
        got = [x for k in range(0, len(texts), 100) for x in encoder(pa.array(texts[k:k + 100]))]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_op13_replay_equals_single_words(ranks):
    tokens, _ = library(ranks)
    rng = random.Random(2)
    words = list({bytes(rng.choice(b"aabtheinrs \xc3\xa9") for _ in range(rng.randint(1, 30))) for _ in range(600)})
    replay = bytebpe.MergeReplay(tokens)
    assert replay.encode(words) == [
        replay.rank[w].to_bytes(4, "little") if w in replay.rank else replay._single(w) for w in words]
    # ranks in which a merge opens one of lower rank: still by definition
    own = [bytes([b]) for b in range(256)] + [b"abc", b"bcd", b"ab", b"cd", b"aab"]
    replay = bytebpe.MergeReplay(own)
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(2, 14))) for _ in range(500)]
    assert replay.encode(words) == [
        replay.rank[w].to_bytes(4, "little") if w in replay.rank else replay._single(w) for w in words]


def test_op13_odd_rows(spark, odd, empty, ranks):
    import public_tokenizers
    _, lib = library(ranks)
    ids = bytebpe.encode(odd, ranks, public_tokenizers.PATTERN)
    got = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in ids.collect())
    assert got == sorted((r.doc_id or -1, lib.encode_ordinary(r.text or "")) for r in odd.collect())
    back = bytebpe.decode(ids, ranks)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((r.text or "").encode() for r in odd.collect())
    assert bytebpe.decode(bytebpe.encode(empty, ranks, public_tokenizers.PATTERN), ranks).count() == 0
