"""Operators 1 and 3 against the tokenizers library and plain lists."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest import SF_SMALL
from llm_rows import empty, odd, vocabulary  # noqa: F401
from dealflow.llm import bpe, queries, wavelet
from dealflow.session import shared_path


def reference(spark, path=SF_SMALL):
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    lib = Tokenizer.from_file(queries.tokenizer_path())
    return lib, [(r.doc_id, lib.encode(r.text or "", add_special_tokens=False).ids) for r in rows]


def test_op1_equals_library(spark):
    lib, want = reference(spark)
    got = {r.doc_id: r for r in queries.QUERIES["op1_bpe"](spark, SF_SMALL).collect()}
    assert len(got) == len(want)
    for key, ids in want:
        text = lib.decode(ids, skip_special_tokens=False)
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, odd, empty, vocabulary):
    lib = Tokenizer.from_file(vocabulary)
    ids = bpe.encode(odd, vocabulary)
    got = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in ids.collect())
    want = sorted((r.doc_id or -1, lib.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect())
    assert got == want
    texts = sorted(r.decoded for r in bpe.decode(ids, vocabulary).collect())
    assert texts == sorted(lib.decode(x, skip_special_tokens=False) for _, x in want)
    assert bpe.encode(empty, vocabulary).count() == 0
    assert bpe.decode(bpe.encode(empty, vocabulary), vocabulary).count() == 0


def test_encoder_on_random_text(vocabulary):
    lib, enc = Tokenizer.from_file(vocabulary), bpe.speculative_encoder(bpe.read_spec(vocabulary))
    library = wavelet.library_encoder(bpe.read_spec(vocabulary))
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeth ingo 'sT.,1٣é́漢🙂 \x1c\x85\xa0<|endoftext|>İΣß") for _ in range(50))
             for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2ff), rng.randint(0, 0xd7ff), rng.randint(0xe000, 0x1ffff)]))
                      for _ in range(30)) for _ in range(400)]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for e in (enc, library):
        assert [np.frombuffer(x, "<u4").tolist() for x in e([t.encode() for t in texts])] == want


def test_words_of_plain_text_equal_library(vocabulary):
    lib, library = Tokenizer.from_file(vocabulary), wavelet.library_encoder(bpe.read_spec(vocabulary))
    rng = random.Random(7)
    signs = ["'", "s", "T", "re", "vE", "ll", "d", "é", "÷", "²", "ª", "·", "1", ".", " ", "\n", "ł", "İ"]
    texts = ["".join(rng.choice(signs[:k]) for _ in range(30)) for k in (8, 16, 17, 18) for _ in range(800)]
    plain = [t.encode() for t in texts if "İ" not in t]
    words, many = bpe.plain_words(plain)
    assert words.to_pylist() == [w for t in plain for w in bpe.WORDS(t.decode())] and len(many) == len(plain)
    assert [np.frombuffer(x, "<u4").tolist() for x in library([t.encode() for t in texts])] == [
        lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_common_words_stay_when_memory_is_full(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CHUNKS", 100)
    monkeypatch.setattr(bpe, "_WORKER", {})
    lib, enc = Tokenizer.from_file(vocabulary), wavelet.library_encoder(bpe.read_spec(vocabulary))
    encoded, plain = [], enc.encode_words
    monkeypatch.setattr(enc, "encode_words", lambda words: encoded.extend(words) or plain(words))
    for k in range(20):  # rare words fill the memory again and again; forms of a word are the word
        texts = [f"The (the) \"THE, the. rare{'abcdefghij'[k % 10]}{'xyz'[k % 3]}q{'r' * j} día Über" for j in range(40)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc([t.encode() for t in texts])] == [
            lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encoded.count(w.encode()) for w in ("the", "día", "über")] == [1, 1, 1]


def test_verified_words_equal_exact_merging(vocabulary):
    model = bpe.SpeculativeBPE(json.loads(bpe.read_spec(vocabulary))["model"])
    rng = random.Random(1)
    parts = ["th", "er", "ing", "an", "on", "tion", "re", "ed", "ou", "é".encode().decode(), "ll", "q", "x"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 14))).encode() for _ in range(5000)})
    got, merged = model.encode_words(words)
    assert 0 < merged < len(words)  # both ways are taken
    assert got == [model.public[model.merge(w + bpe.END)].tobytes() for w in words]


def test_wavelet_matrix_queries():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 300, 3000), np.array([], int), np.array([0]), np.full(700, 65535), np.array([70000, 2])):
        keys, lengths, wm = wavelet.unpack(wavelet.pack([5, None], [len(ids), 0], ids.astype("<u4")))
        assert wm.all_ids().tolist() == ids.tolist() and lengths.tolist() == [len(ids), 0]
        for i in range(0, len(ids), 97):
            assert wm.access(i) == ids[i]
            assert wm.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        for token in {*ids[:20].tolist(), 299, 5, 1 << 20}:
            places = np.flatnonzero(ids == token).tolist()
            assert wm.count(token) == len(places)
            assert wm.locate(token)[:50] == places[:50]
        with pytest.raises(IndexError):
            wm.select(7 if len(ids) == 0 else int(ids[0]), 10 ** 6)


def test_op3_equals_library(spark):
    _, want = reference(spark)
    got = {r.doc_id: r for r in queries.QUERIES["op3_wavelet_shards"](spark, SF_SMALL).collect()}
    start = 0
    for key, ids in want:
        ids = [*ids, 2]
        assert (got[key].start, got[key].n_tokens) == (start, len(ids))
        assert got[key].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_op3_many_shards_and_odd_rows(spark, odd, empty, vocabulary, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TEXT", 20_000)
    shards = wavelet.write_shards(odd, shared_path(spark, "t"), vocabulary)
    assert shards.count() > 2
    rows = sorted(wavelet.read_documents(shards).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 7, 8]
    none = wavelet.write_shards(empty, shared_path(spark, "t"), vocabulary)
    assert wavelet.read_documents(none).count() == 0
