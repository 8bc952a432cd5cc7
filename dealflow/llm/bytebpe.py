"""Operator 13: byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut before blanks that always start a word, and the distinct chunks
into words.  The words that a slice of texts brings and the worker does not know
yet form a corpus.  Its bytes lie in one array, an inverted index leads from
each mergeable pair (by the rank of what it makes) to the places where it
stands, and the merges are replayed over the whole corpus in rank order: a merge
visits its places only, all at once, and updates the two neighbours of each.
Words stay known from slice to slice, within a fixed number.

The corpus of one replay is what is new to a worker, not the table: the table's
vocabulary grows with it, and joining it back to every text would shuffle more
than the texts.

Words are those of the tokenizer's pattern as the tiktoken library finds them.
Characters up to U+017F have one class in all Unicode versions; what the library
takes others for is asked of the library itself, once for each character.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from dealflow.llm.common import byte_list, slices

MOST_WORDS = 150_000     # words a worker remembers
CORPUS_BYTES = 6 << 20   # bytes of text whose new words are replayed together
WINDOW = 1 << 20         # a text with more bytes is cut into chunks window by window
MOST_GATHERED = 1 << 18  # texts' ids are put together for so many chunks at once
# What the pattern's white space means in the library.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A blank before anything else starts a word, whatever stands before it.
BLANK = re.compile(f" (?=[^{SPACE}])")
PLAIN = re.compile("[\0-\u017f]*").fullmatch
FOREIGN = re.compile("[^\0-\u017f]")
# For Arrow's functions: a blank that starts no word; chunks that are cut one by one.
ODD_BLANK = f" (?:[{SPACE}]|\\z)"
ODD_CHUNK = f"^$|[{SPACE}]|[^\\x00-\u017f]"


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by id (a few MB whatever the data)."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("rank file with gaps")
    return [ranks[k] for k in range(len(ranks))]


class WordCutter:
    """The words of a text under a pattern, as the tiktoken library finds them."""

    def __init__(self, pattern: str):
        own = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.words = regex.compile(own)
        # A probe vocabulary that shows whether a character joins the word before it.
        tokens = [bytes([b]) for b in range(256)]
        tokens += [a + bytes([b]) for a in (b"a", b"1", b"!") for b in range(0xC2, 0xF5)]
        self.probe = tiktoken.Encoding("probe", pat_str=pattern, special_tokens={},
                                       mergeable_ranks={t: k for k, t in enumerate(tokens)})
        self.stand_in: dict[str, str] = {}

    def _class(self, c: str) -> str:
        """A plain character that the pattern treats as the library does ``c``."""
        if c not in self.stand_in:
            joins = (p for p in ("a", "1", "!") if self.probe.encode_ordinary(p + c)[0] > 255)
            self.stand_in[c] = {"a": "à", "1": "1", "!": "!"}.get(next(joins, ""), "\t")
        return self.stand_in[c]

    def words_of(self, chunk: str) -> list[str]:
        if PLAIN(chunk):
            return self.words.findall(chunk)
        shown = FOREIGN.sub(lambda m: self._class(m[0]), chunk)
        return [chunk[m.start():m.end()] for m in self.words.finditer(shown)]

    def cut(self, chunks: pa.Array, front: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words of all chunks with ``front`` before each, words of each chunk,
        and which chunks these are in turn."""
        odd = pc.match_substring_regex(chunks, ODD_CHUNK).to_numpy(zero_copy_only=False)
        # Chunks without white space are cut in one go: a line end between two
        # is a word of its own.
        plain = [front + c for c in chunks.filter(pa.array(~odd)).to_pylist()]
        found = self.words.findall("\n".join(plain))
        ends = np.array([k for k, w in enumerate(found) if w == "\n"], np.int64)
        size = np.diff(ends, prepend=-1, append=len(found)) - 1 if plain else ends
        words = [w for w in found if w != "\n"]
        apart = [self.words_of(front + c) for c in chunks.filter(pa.array(odd)).to_pylist()]
        words += [w for ws in apart for w in ws]
        return (words, np.append(size, np.fromiter(map(len, apart), np.int64, len(apart))),
                np.append(np.flatnonzero(~odd), np.flatnonzero(odd)))


def windows(text: str) -> Iterator[list[str]]:
    """Chunks of a text of any length, a bounded number at a time.

    The blank in front of every chunk but a window's first is left out.
    """
    at = 0
    while True:
        end = BLANK.search(text, at + WINDOW) if len(text) - at > WINDOW else None
        yield BLANK.split(text[at:end.start()] if end else text[at:])
        if not end:
            return
        at = end.start()


def gather(flat: np.ndarray, long: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces ``code`` of ``flat``, whose pieces are ``long``: joined, and their lengths."""
    start, each = (np.cumsum(long) - long)[code], long[code]
    until = np.cumsum(each)
    return flat[np.repeat(start - until + each, each) + np.arange(until[-1] if len(until) else 0)], each


class MergeReplay:
    """Ids of whole word lists under a rank table."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        # every way to put a token together from two
        made = [(x * len(tokens) + y, k) for k, t in enumerate(tokens) for i in range(1, len(t))
                if (x := self.rank.get(t[:i])) is not None and (y := self.rank.get(t[i:])) is not None]
        self.pair_key, self.pair_made = (a[np.argsort([k for k, _ in made])] for a in (
            np.array([k for k, _ in made]), np.array([m for _, m in made], np.int32)))

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of what each two tokens make; -1 if nothing, or either is none."""
        key = a.astype(np.int64) * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (a >= 0) & (b >= 0), self.pair_made[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian uint32.  A word that is a token is that token."""
        whole = [self.rank.get(w) for w in words]
        parts = [w for w, k in zip(words, whole) if k is None]
        found = iter(self._replay(parts) if parts else [])
        return [next(found) if k is None else k.to_bytes(4, "little") for k in whole]

    def _replay(self, words: list[bytes]) -> list[bytes]:
        # A place is a byte of the corpus.  None (-1) is held in front, behind
        # each word, and where a token was swallowed.
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1)
        held = np.full(int(ends[-1]) + 1, -1, np.int32)
        inside = np.ones(len(held), bool)
        inside[0] = inside[ends] = False
        held[inside] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.minimum(np.arange(1, len(held) + 1, dtype=np.int32), len(held) - 1)
        before = np.maximum(np.arange(-1, len(held) - 1, dtype=np.int32), 0)
        makes = np.append(self._made(held[:-1], held[1:]), np.int32(-1))
        index: dict[int, list[np.ndarray]] = {}
        turns: list[int] = []

        def enter(places: np.ndarray) -> None:
            got = makes[places]
            order = np.argsort(got, kind="stable")
            got, places = got[order], places[order]
            cuts = np.flatnonzero(got[1:] != got[:-1]) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(got)]):
                if stop > start and (made := int(got[start])) >= 0:
                    if made not in index:
                        index[made] = []
                        heapq.heappush(turns, made)
                    index[made].append(places[start:stop])

        enter(np.flatnonzero(makes >= 0).astype(np.int32))
        early = [np.zeros(0, np.int32)]  # places where a merge opened one of no higher rank
        while turns:
            now = heapq.heappop(turns)
            found = index.pop(now)
            at = np.concatenate(found) if len(found) > 1 else found[0]
            at = np.sort(at[makes[at] == now])  # the index may be out of date
            if not at.size:
                continue
            # of places that overlap, the first, third, ... of each chain merge
            first = np.append(True, after[at[:-1]] != at[1:])
            nth = np.arange(len(at))
            at = at[(nth - np.maximum.accumulate(np.where(first, nth, 0))) % 2 == 0]
            right = after[at]
            far = after[right]
            held[at], held[right], makes[right] = now, -1, -1
            after[at], before[far] = far, at
            left = before[at]
            fresh = held[left] >= 0
            fresh[1:] &= left[1:] != at[:-1]
            places = np.concatenate([at, left[fresh]])
            makes[places] = self._made(held[places], held[after[places]])
            low = places[(makes[places] >= 0) & (makes[places] <= now)]
            if low.size:
                early.append(low)
            enter(places)
        kept = held >= 0
        raw, bound = held[kept].astype("<u4").tobytes(), np.append(0, np.cumsum(kept)[ends] * 4).tolist()
        out = [raw[a:b] for a, b in zip(bound, bound[1:])]
        # ranks that are no merge order: these words one merge at a time
        for k in np.unique(np.searchsorted(ends, np.concatenate(early))).tolist():
            out[k] = self._single(words[k])
        return out

    def _single(self, word: bytes) -> bytes:
        """One word by definition: the lowest rank, leftmost, again and again."""
        parts = [bytes([b]) for b in word]
        while True:
            made = [self.rank.get(a + b, len(self.tokens)) for a, b in zip(parts, parts[1:])]
            if not made or (least := min(made)) == len(self.tokens):
                return np.array([self.rank[p] for p in parts], "<u4").tobytes()
            k = made.index(least)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]


class TextEncoder:
    """Texts to ids, with the words met so far at hand."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.cutter, self.replay = WordCutter(pattern), MergeReplay(tokens)
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MOST_WORDS:  # those in use now stay
            self.known = {w: self.known[w] for w in words if w in self.known}
        self.known.update(zip(new, self.replay.encode([w.encode() for w in new])))
        return [self.known[w] for w in words]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: none) as little-endian uint32."""
        texts = pc.fill_null(texts, "")
        long = pc.greater(pc.binary_length(texts), WINDOW).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, ODD_BLANK).to_numpy(zero_copy_only=False) & ~long
        plain = ~odd & ~long
        # Where every blank starts a word, plain splitting is enough.
        split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        apart = [next(windows(t)) for t in texts.filter(pa.array(odd)).to_pylist()]
        flat = pa.concat_arrays([split.flatten(), pa.array([c for cs in apart for c in cs], split.type.value_type)])
        size = np.append(np.diff(split.offsets.to_numpy()), np.fromiter(map(len, apart), np.int64, len(apart)))
        out = np.empty(len(texts), object)
        out[np.append(np.flatnonzero(plain), np.flatnonzero(odd))] = self.encode_chunks(flat, size)
        for k in np.flatnonzero(long).tolist():
            parts = (self.encode_chunks(pa.array(w), np.array([len(w)])) for w in windows(texts[k].as_py()))
            out[k] = b"".join([p[0] for p in parts])
        return out.tolist()

    def encode_chunks(self, flat: pa.Array, size: np.ndarray) -> np.ndarray:
        """Ids of texts given by their chunks, ``size`` of them each."""
        ends = np.cumsum(size)
        head = np.zeros(len(flat), bool)
        head[ends - size] = True
        code, words, sizes = np.empty(len(flat), np.int32), [], [np.zeros(0, np.int64)]
        for part, front in ((~head, " "), (head, "")):
            coded = flat.filter(pa.array(part)).dictionary_encode()
            found, n, order = self.cutter.cut(coded.dictionary, front)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order)) + sum(map(len, sizes))
            code[part] = place[coded.indices.to_numpy()]
            words += found
            sizes.append(n)
        coded = pa.array(words, pa.string()).dictionary_encode()
        ids = self.learn(coded.dictionary.to_pylist())
        joined, each = gather(np.frombuffer(b"".join(ids), "<u4"),
                              np.fromiter(map(len, ids), np.int64, len(ids)) // 4, coded.indices.to_numpy())
        bound = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(np.concatenate(sizes)))]
        long = np.diff(bound)
        out = np.empty(len(size), object)
        at = 0
        while at < len(size):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + MOST_GATHERED, "right")))
            got, each = gather(joined, long, code[ends[at] - size[at]:ends[stop - 1]])
            raw, cuts = got.tobytes(), np.append(0, np.cumsum(each) * 4)
            cuts = cuts[np.append(0, ends[at:stop] - ends[at] + size[at])].tolist()
            for k, (a, b) in enumerate(zip(cuts, cuts[1:]), at):
                out[k] = raw[a:b]
            at = stop
        return out


_WORKER: dict = {}  # what a Python worker keeps between tasks, by tokenizer


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids) of every row; ids are little-endian uint32 bytes.

    ``path`` names a rank file; its contents go to the executors.  Special
    tokens are ordinary text.  A null or empty text has no ids; repeated rows
    and a null key are kept; a text of any length is cut window by window.
    """
    spec = df.sparkSession.sparkContext.broadcast((read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pat = spec.value
        name = ("encoder", hash(tuple(tokens)), pat)
        if name not in _WORKER:
            _WORKER[name] = TextEncoder(tokens, pat)
        for b in slices(batches, "text", CORPUS_BYTES):
            ids = _WORKER[name](b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``decoded`` (the bytes that the ids stand for) and
    ``id_text`` (the ids in decimal, joined by commas).

    Bytes, because ids cut at any place need not make valid UTF-8.  No ids (or
    null) give no bytes; an id outside the file is an error.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = spec.value
        digits = [str(k) for k in range(len(tokens))]
        for b in slices(batches, ids, WINDOW):
            found = [np.frombuffer(x, "<u4").tolist() for x in byte_list(b.column(ids))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep),
                 pa.array([b"".join(map(tokens.__getitem__, x)) for x in found], pa.binary()),
                 pa.array([",".join(map(digits.__getitem__, x)) for x in found], pa.string())],
                [*keep, "decoded", "id_text"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, ids).mapInArrow(run, f"{schema}, decoded binary, id_text string")
