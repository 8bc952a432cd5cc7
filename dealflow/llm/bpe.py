"""Operator 1: BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match.  The guess is the
BPE result exactly when every adjacent pair of its tokens would also come out
of merging the pair's own text; that is tested for all pairs of a slice at
once with array operations on the merge table.  Only words with a failing pair
are merged step by step.

Texts are cut into words, and each distinct word is encoded once while it stays
in the worker's bounded memory.  Chunks between ASCII white space, which no token
crosses, that hold characters outside a plain Latin set are normalised and split
by the tokenizers library's own components, also once; the BPE is always the one
written here.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from dealflow.llm.common import byte_list, slices

# Characters for which lower-casing, composition and the class
# letter / number / other are the same in every Unicode version.
_PLAIN, _SPACE = "\x21-\x7e¡-įı-ňŊ-ž", "\t-\r "
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ž", "0-9²³¹¼½¾"
PLAIN_TEXT = re.compile(f"[{_PLAIN}{_SPACE}]*").fullmatch
# The words of a vocabulary's file, and the same in plain text of either case.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD = (f"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|[{_LETTER}]+|[{_NUMBER}]"
         f"|[^{_SPACE}{_LETTER}{_NUMBER}]+")
# A chunk with any other character comes whole.
WORDS = re.compile(f"(?<![^{_SPACE}])[{_PLAIN}]*+[^{_PLAIN}{_SPACE}][^{_SPACE}]*|{_WORD}").findall
CHUNKS = re.compile(f"[^{_SPACE}]+").findall
# Space 0, letter 1, number 2, other 3 of the plain characters.
_CLASS = np.array([0 if re.match(f"[{_SPACE}]", c) else 1 if re.match(f"[{_LETTER}]", c) else
                   2 if re.match(f"[{_NUMBER}]", c) else 3 for c in map(chr, range(0x180))], "u1")
END = b"\xff"  # stands for the end of a word; no UTF-8 text holds this byte
SHORT = 24  # bytes of a word that is merged together with others
MOST_CHUNKS = 250_000  # words (and other chunks) a worker remembers between slices


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 as is, the rest from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class SpeculativeBPE:
    """Merge tables of a BPE vocabulary whose words end with a suffix."""

    def __init__(self, model: dict):
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        byte_of = byte_characters()

        def raw(token: str) -> bytes:
            stem = token.removesuffix(suffix)
            return bytes(byte_of[c] for c in stem) + (END if stem != token else b"")

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b: (a, b) for a, b in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token: pairs cannot be verified")
        # Own numbers: single bytes first, then merged tokens by merge rank.
        order = sorted((t for t in vocab if t not in made), key=vocab.__getitem__)
        order += [a + b for a, b in merges]
        number = {t: k for k, t in enumerate(order)}
        self.public = np.array([vocab[t] for t in order], "<u4")
        self.left = np.arange(len(order))
        self.right = np.arange(len(order))
        self.pair: dict[tuple[int, int], int] = {}
        for t, (a, b) in made.items():
            k = number[t]
            self.left[k], self.right[k] = number[a], number[b]
            self.pair[number[a], number[b]] = k
        keys = np.array([a * len(order) + b for a, b in self.pair], np.int64)
        self.pair_keys = np.sort(keys)
        self.pair_made = np.array(list(self.pair.values()), np.int64)[np.argsort(keys)]
        self.atom = {raw(t): number[t] for t in order if t not in made}
        # Greedy proposals use only tokens that merging their own text gives back.
        self.token = dict(self.atom)
        for t in made:
            if self.merge(raw(t)) == [number[t]]:
                self.token[raw(t)] = number[t]
        self.token.pop(END, None)  # the byte that marks the end is never text
        self.length = np.zeros(len(order), np.int64)
        self.longest_match = ahocorasick.Automaton()
        for t, k in self.token.items():
            self.length[k] = len(t)
            self.longest_match.add_word(t.decode("latin-1"), k)
        self.longest_match.make_automaton()
        # Numbers of single bytes inside a word and at its end.
        self.inner, self.final = (np.array([self.atom.get(bytes([b]) + tail, -1) for b in range(256)])
                                  for tail in (b"", END))

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first."""
        cut = len(word) - 2 if word.endswith(END) else len(word)
        tokens = [self.atom[word[i:i + 1]] for i in range(cut)]
        if word.endswith(END):
            tokens.append(self.atom[word[-2:]])
        return self._merge_long(tokens)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair merges into; ``len(self.left)`` if it does not."""
        key = a * len(self.left) + b
        pos = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[pos] == key) & (a >= 0) & (b >= 0), self.pair_made[pos], len(self.left))

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """:meth:`merge` of many short words at once, one merge per word and round."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        col = np.arange(int(size.max()) + 1)
        tokens = np.full((len(words), len(col)), -1)
        inside = col < size[:, None]
        text = np.frombuffer(b"".join(words), np.uint8)
        tokens[inside] = self.inner[text]
        last = np.cumsum(size) - 1
        tokens[np.arange(len(words)), size - 1] = self.final[text[last]]
        made = np.full(tokens.shape, len(self.left))
        made[:, :-1] = self._made(tokens[:, :-1], tokens[:, 1:])
        done: list = [None] * len(words)
        at = np.arange(len(words))
        while at.size:
            low = made.min(axis=1)
            for r in np.flatnonzero(low == len(self.left)).tolist():
                done[at[r]] = tokens[r][tokens[r] >= 0]
            go = low < len(self.left)
            at, tokens, made, low = at[go], tokens[go], made[go], low[go]
            if not at.size:
                break
            i, r = made.argmin(axis=1), np.arange(len(at))
            shift = np.minimum(col + (col > i[:, None]), len(col) - 1)
            tokens, made = np.take_along_axis(tokens, shift, 1), np.take_along_axis(
                made, np.minimum(col + (col >= i[:, None]), len(col) - 1), 1)
            tokens[r, i] = low
            made[r, i] = self._made(low, tokens[r, i + 1])
            left = np.maximum(i - 1, 0)
            made[r, left] = np.where(i > 0, self._made(tokens[r, left], low), made[r, left])
        return done

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """A heap of mergeable pairs: no word is too long for it."""
        after = [*range(1, len(tokens)), -1]
        before = [*range(-1, len(tokens) - 1)]
        heap = [(self.pair[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in self.pair]
        heapq.heapify(heap)
        while heap:
            made, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j < 0 or self.pair.get((tokens[i], tokens[j])) != made:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := self.pair.get((tokens[a], tokens[b]))) is not None:
                    heapq.heappush(heap, (m, a))
        return [t for t in tokens if t >= 0]

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: tokens, their words, complete words."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        found = np.array(list(self.longest_match.iter_long((END.join(words) + END).decode("latin-1"))), np.int64)
        last, tokens = found.reshape(-1, 2).T
        owner = np.searchsorted(np.cumsum(size), last, "right")
        covered = np.bincount(owner, self.length[tokens], len(words))
        return tokens, owner, covered == size  # matches never overlap

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between each pair of tokens.

        Undoes the later merge of the two tokens again and again; the border is
        lost if two pieces that touch it would have merged before that.
        """
        ok = np.ones(len(first), bool)
        at = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(first), len(self.left) + 1)
        while at.size:
            key = a * len(self.left) + b
            pos = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            lost = (self.pair_keys[pos] == key) & (self.pair_made[pos] < limit)
            ok[at[lost]] = False
            split_a, split_b = self.right[a], self.left[b]
            whole_a, whole_b = split_a == a, split_b == b
            use_a = np.where(a > b, ~whole_a, whole_b & ~whole_a)
            limit = np.where(use_a, a, b + 1)
            go = ~lost & ~(whole_a & whole_b)
            a, b = np.where(use_a, split_a, a)[go], np.where(use_a, b, split_b)[go]
            at, limit = at[go], limit[go]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], int]:
        """Public ids of each word as little-endian uint32; how many were merged."""
        if not words:
            return [], 0
        tokens, owner, complete = self.propose(words)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(tokens[inner] * len(self.left) + tokens[inner + 1], return_inverse=True)
        good = self.compatible(pairs // len(self.left), pairs % len(self.left))
        complete[owner[inner[~good[back]]]] = False
        ids, size = self.public[tokens].tobytes(), np.bincount(owner, minlength=len(words)) * 4
        out = [ids[e - n:e] for e, n in zip(np.cumsum(size).tolist(), size.tolist())]
        failing = np.flatnonzero(~complete).tolist()
        short = sorted((k for k in failing if len(words[k]) <= SHORT), key=lambda k: len(words[k]))
        for start in range(0, len(short), 1 << 12):
            part = short[start:start + (1 << 12)]
            for k, merged in zip(part, self.merge_many([words[k] for k in part])):
                out[k] = self.public[merged].tobytes()
        for k in failing:
            if len(words[k]) > SHORT:
                out[k] = self.public[self.merge(words[k] + END)].tobytes()
        return out, len(failing)


def ids_of(size: np.ndarray, ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids of ``words`` one after the other; word k has ``size[k]`` of ``ids``, in order."""
    many = size[words]
    shift = (np.cumsum(size) - size)[words] - (np.cumsum(many) - many)
    return ids[np.arange(int(many.sum())) + np.repeat(shift, many)]


def joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids."""
    return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")


def plain_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all plain texts (as :data:`WORDS` finds them), and how many each text has."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n\n\n", np.uint8)
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw >= 0xC0)  # of two bytes, in plain text
    kind[lead] = kind[lead + 1] = _CLASS[(raw[lead] & 0x1F).astype(np.int64) << 6 | raw[lead + 1] & 0x3F]
    new = kind == 2
    new[0] |= kind[0] > 0
    new[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0)
    new[lead + 1] = False
    # an apostrophe alone before one of the short endings takes it along
    quote = np.flatnonzero(raw == ord("'"))
    quote = quote[new[quote] & (kind[quote + 1] == 1)]
    one, two = raw[quote + 1] | 32, raw[quote + 2] | 32
    short = np.isin(one, list(b"stmd")) & (raw[quote + 1] < 128)
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    long &= (raw[quote + 1] < 128) & (raw[quote + 2] < 128)
    after = np.concatenate([quote[short] + 2, quote[long] + 3])
    new[quote[short | long] + 1] = False
    new[after[kind[after] == 1]] = True
    starts, inside = np.flatnonzero(new), kind > 0
    ends = np.concatenate([np.cumsum(inside, dtype=np.int32)[starts] - 1, [np.count_nonzero(inside)]]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw[inside]))
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.diff(np.searchsorted(starts, edges))


class ChunkEncoder:
    """Ids of texts, word by word, under a tokenizer file's text rules.

    ``encode_words`` gives the number of ids of each word, and all ids.
    """

    def __init__(self, spec: str, encode_words: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        conf = json.loads(spec)
        kinds = [n["type"] for n in conf["normalizer"]["normalizers"]]
        split, level = conf["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or (split["type"], split["behavior"], split["invert"],
                level["type"], level["use_regex"]) != ("Split", "Removed", True, "ByteLevel", False):
            raise ValueError("tokenizer file with other text rules than lower-cased words")
        self.own_split = split["pattern"]["Regex"] == SPLIT
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        library = Tokenizer.from_str(spec)
        self.normal, self.presplit = library.normalizer, library.pre_tokenizer
        self.byte_of = byte_characters()
        self.encode_words = encode_words
        # remembered words by number: how many ids each has, all ids, and when it was last met
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.size, self.ids, self.met = np.empty(0, np.int64), np.empty(0, "<u4"), np.empty(0, np.int64)
        self.clock = 0

    def pieces(self, text: str) -> list[str]:
        """Words of plain chunks, other chunks whole, and special tokens."""
        if "<|" in text and len(parts := self.cut(text)) > 1:
            return [x for k, p in enumerate(parts) for x in ([p] if k % 2 else self.pieces(p))]
        if not self.own_split:
            return CHUNKS(text)
        return WORDS(text)

    def split_piece(self, piece: str) -> list[bytes | str]:
        if piece in self.special:
            return [piece]
        if self.own_split and PLAIN_TEXT(piece):
            return [piece.lower().encode()]
        found = self.presplit.pre_tokenize_str(self.normal.normalize_str(piece))
        return [bytes(self.byte_of[c] for c in p) for p, _ in found]

    def learn(self, new: list[str]) -> None:
        """Encode the pieces that were numbered last."""
        special, lines = list(self.special), "\n".join(new)
        if self.own_split and PLAIN_TEXT(lines) and self.special.keys().isdisjoint(new):
            made = [[w] for w in lines.lower().encode().split(b"\n")]
        else:
            made = [self.split_piece(p) for p in new]
        need = list({w for ws in made for w in ws}.difference(special))
        size, ids = self.encode_words(need)
        size = np.concatenate([size, np.ones(len(special), np.int64)])
        ids = np.concatenate([ids, np.array([self.special[p] for p in special], "<u4")])
        number = dict(zip([*need, *special], count()))
        words = np.fromiter((number[w] for ws in made for w in ws), np.int64)
        ends = np.concatenate([[0], np.cumsum(size[words])])[np.cumsum([0, *map(len, made)])]
        self.size = np.concatenate([self.size, np.diff(ends)])
        self.ids = np.concatenate([self.ids, ids_of(size, ids, words)])
        self.met = np.concatenate([self.met, np.full(len(new), self.clock)])

    def forget(self) -> None:
        """Keep the half of the words that was met last: the common ones are in it."""
        words = list(self.number)
        keep = np.argsort(-self.met, kind="stable")[:MOST_CHUNKS // 2]
        self.number = defaultdict(count(len(keep)).__next__, zip([words[k] for k in keep.tolist()], count()))
        self.size, self.ids, self.met = self.size[keep], ids_of(self.size, self.ids, keep), self.met[keep]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        if len(self.size) > MOST_CHUNKS:
            self.forget()
        self.clock += 1
        decoded = [t.decode() for t in texts]
        plain = [self.own_split and "<|" not in t and PLAIN_TEXT(t) is not None for t in decoded]
        easy, rest = ([k for k, p in enumerate(plain) if p == want] for want in (True, False))
        words, many = plain_words([texts[k] for k in easy])
        found = [pa.array(self.pieces(decoded[k]), pa.string()) for k in rest]
        words = pa.concat_arrays([words, *found]).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        if len(self.number) > len(self.size):
            self.learn(list(islice(self.number, len(self.size), None)))
        self.met[numbers] = self.clock
        at = numbers[words.indices.to_numpy()]
        ids = memoryview(ids_of(self.size, self.ids, at).tobytes())
        ends = np.concatenate([[0], np.cumsum(self.size[at])])[np.cumsum([0, *many.tolist(), *map(len, found)])] * 4
        out = [b""] * len(texts)
        for k, s, e in zip([*easy, *rest], ends.tolist(), ends[1:].tolist()):
            out[k] = bytes(ids[s:e])
        return out


def read_spec(path: str) -> str:
    """Contents of a tokenizer file (a few MB whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_WORKER: dict = {}  # what a Python worker keeps between tasks, by tokenizer


def speculative_encoder(spec: str) -> ChunkEncoder:
    key = ("speculative", hash(spec))
    if key not in _WORKER:
        bpe = SpeculativeBPE(json.loads(spec)["model"])
        _WORKER[key] = ChunkEncoder(spec, lambda words: joined(bpe.encode_words(words)[0]))
    return _WORKER[key]


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids) of every row; ids are little-endian uint32 bytes.

    ``path`` names a tokenizer file; its contents go to the executors, which
    need not have the file.  Special tokens are found in texts as the library
    finds them and none are added.  A null or empty text has no ids; repeated
    rows stay; a null key is kept.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = speculative_encoder(spec.value)
        for b in slices(batches, "text"):
            ids = encoder(byte_list(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``decoded``: token strings joined by spaces.

    That is what the library's decode does with a file that names no decoder;
    special tokens stay.  No ids (or null) decode to the empty text.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("strings", hash(spec.value))
        if key not in _WORKER:
            conf = json.loads(spec.value)
            if conf["decoder"] is not None:
                raise ValueError("tokenizer file with a decoder of its own")
            strings = conf["model"]["vocab"] | {t["content"]: t["id"] for t in conf["added_tokens"]}
            _WORKER[key] = {i: s.encode() for s, i in strings.items()}
        get = _WORKER[key].__getitem__
        for b in slices(batches, ids):
            texts = [b" ".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in byte_list(b.column(ids))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(texts, pa.binary()).cast(pa.string())], [*keep, "decoded"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, ids).mapInArrow(run, f"{schema}, decoded string")
