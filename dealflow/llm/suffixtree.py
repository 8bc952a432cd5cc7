"""Operator 9: language-model scores from a probabilistic suffix tree.

Symbols are the lower-cased words of a text and one end.  States of the tree
are contexts of up to ``LONGEST`` words.  A context is a candidate if the
training texts have it ``MIN_COUNT`` times, whatever the corpus, and stays if a
divergence test finds that its next-word counts, each left out once, are better
predicted by itself than by its longest kept suffix.  Next-word probabilities
are smoothed towards that suffix in proportion to the number of different next
words; the root gives unseen words the share that words seen once have.  A
token's probability is that of the longest kept suffix of what precedes it.

How it runs: texts are cut into chunks, each with its own word list.  Chunks
send their distinct words with counts as one block per part, a part being a
hash range of words; a part adds up the blocks of all chunks and answers each
block with counts.  Contexts follow by length in the same
way, a part being a hash range of contexts: a chunk sends (context, word)
counts with the word's probability under the longest kept suffix, and the part
tests the contexts and answers with counts.  The corpus count of a context with
a word is that of the longer context they make, so only candidates are ever sent.  Words, contexts and their counts stay distributed; nothing of them is
collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.llm.common import materialize, mix64, remove_table, runs, slices
from dealflow.session import remove_path, shared_path

MIN_COUNT = 50           # training occurrences, for a context
MIN_SHARE = 0.0          # of training tokens, for a smaller tree: none by default
LONGEST = 6              # words of a context: the order of the model
MIN_GAIN = 50.0          # nats that a kept context saves on the training text
CHUNK_BYTES = 3 << 20    # text per chunk
PART_ENTRIES = 1 << 18   # (word, context) entries per part, about
BATCH_BYTES = 8 << 20    # of an Arrow batch of blocks
GROUPS = 4               # of chunks, that take their answers one after the other
TURNS = 2                # in which the parts get the keys of a length
FOLDS = 10
END = b"\n"              # no word holds white space
_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one value, their bytes compressed place by place; the caller knows their types."""
    out = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(a).view("u1").reshape(-1, a.itemsize).T.tobytes()
        packed = _ZSTD.compress(raw, asbytes=True)
        out += [len(raw).to_bytes(8, "little"), len(packed).to_bytes(8, "little"), packed]
    return b"".join(out)


def expand(blob: bytes, *kinds: str) -> list:
    """The arrays of :func:`squeeze`; the kind ``bytes`` stays bytes."""
    out, at = [], 0
    for kind in kinds:
        size, n = (int.from_bytes(blob[at + k:at + k + 8], "little") for k in (0, 8))
        raw = _ZSTD.decompress(blob[at + 16:at + 16 + n], size, asbytes=True)
        out.append(raw if kind == "bytes" else np.frombuffer(raw, "u1").reshape(
            np.dtype(kind).itemsize, -1).T.copy(order="C").view(kind).ravel())
        at += 16 + n
    return out


def held_out(doc_id: int | None) -> bool:
    """Documents the model does not learn from; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


# -- chunks ------------------------------------------------------------------

def make_chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: its documents, tokens and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        keys: list = []
        counts: list[np.ndarray] = []
        words: list[pa.Array] = []
        size = 0

        def row() -> pa.RecordBatch:
            lengths = np.concatenate(counts) + 1
            coded = pa.concat_arrays(words).dictionary_encode()
            vocab = b" ".join(coded.dictionary.cast(pa.binary()).to_pylist())
            ids = np.zeros(int(lengths.sum()), "<u4")  # a text's end is word 0
            inner = np.ones(len(ids), bool)
            inner[np.cumsum(lengths) - 1] = False
            ids[inner] = coded.indices.to_numpy() + 1
            doc_ids = np.array([0 if k is None else k for k in keys], "<i8")
            null = np.array([k is None for k in keys], "u1")
            blob = squeeze(doc_ids, null, lengths.astype("<u4"), ids, vocab)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{seq}"]), pa.array([blob], pa.binary())], ["chunk", "blob"])

        for b in slices(batches, "text", CHUNK_BYTES):
            keys += b.column("doc_id").to_pylist()
            texts = pc.ascii_lower(pc.fill_null(b.column("text"), ""))
            cut = pc.ascii_split_whitespace(texts)
            flat = cut.flatten()
            real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.concatenate([[0], pc.list_value_length(cut).to_numpy()]))
            counts.append(np.diff(np.concatenate([[0], np.cumsum(real)])[ends]))
            words.append(flat.filter(pa.array(real)))
            size += int(pc.sum(pc.binary_length(texts)).as_py()) + len(texts)
            if size >= CHUNK_BYTES:
                yield row()
                keys, counts, words, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "chunk string, blob binary")


class Chunk:
    """A chunk whose words are numbered by their part, then by hash."""

    def __init__(self, blob: bytes, parts: int):
        self.doc_ids, null, lengths, ids, text = expand(blob, "<i8", "u1", "<u4", "<u4", "bytes")
        self.null, self.lengths = null.astype(bool), lengths.astype(np.int64)
        words = [END, *text.split(b" ")] if text else [END]
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        part = (hashes[:, 0] % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((hashes[:, 1], hashes[:, 0], part))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.hashes, self.part = hashes[order], part[order]
        self.token = rank[ids]

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(part, block): hashes and training counts of the words of one part."""
        learn = np.repeat([not held_out(None if n else int(k)) for k, n in zip(self.doc_ids, self.null)], self.lengths)
        count = np.bincount(self.token[learn], minlength=len(self.part))
        starts = np.flatnonzero(np.diff(self.part, prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(self.part)]):
            yield int(self.part[s]), squeeze(self.hashes[s:e], count[s:e].astype("<u4"))


def count_words(blocks: list[bytes], part: int, parts: int) -> tuple[list[bytes], tuple[int, int, int]]:
    """One part's answer to each block, the words' corpus counts and numbers; then tokens, words and words seen once.

    A number is one word's in the whole corpus, and small for a common word: the
    parts take turns, each in the order of its counts.
    """
    got = [expand(b, "<u8", "<u4") for b in blocks]
    sizes = np.cumsum([0, *(len(g[1]) for g in got)])
    hashes = np.concatenate([g[0] for g in got]).reshape(-1, 2)
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]).any(axis=1)])
    word = np.empty(len(hashes), np.int64)
    word[order] = np.cumsum(new) - 1
    count = np.bincount(word, np.concatenate([g[1] for g in got])).astype("<i8")
    totals = (int(count.sum()), int((count > 0).sum()), int((count == 1).sum()))
    number = np.empty(len(count), "<u8")
    number[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype="<u8") * np.uint64(parts) + np.uint64(part)
    return [squeeze(count[word[s:e]], number[word[s:e]]) for s, e in zip(sizes, sizes[1:])], totals


# -- the passes ---------------------------------------------------------------

@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches, and shuffle files that go when their query ends, for the passes below.

    A row here is a whole block or chunk, so a batch of the default size would
    be several hundred of them; a pass is written once and never read twice.
    """
    settings = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
                "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _by_part(chunks: DataFrame, blocks: Callable[[bytes], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(part, chunk, blob): the blocks of every chunk, those of one part together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, blob in zip(b.column("chunk").to_pylist(), b.column("blob")):
                found = list(blocks(blob.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in found], pa.int64()), pa.array([name] * len(found), pa.string()),
                     pa.array([x for _, x in found], pa.binary())], ["part", "chunk", "blob"])

    sent = chunks.select("chunk", "blob").mapInArrow(run, "part long, chunk string, blob binary")
    return sent.repartition("part").sortWithinPartitions("part")


def _with_answers(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Every chunk (as part -1) followed by its answers in the order of parts."""
    own = chunks.select("chunk", F.lit(-1).cast("long").alias("part"), "blob")
    return own.unionByName(answers.select("chunk", "part", "blob")).repartition("chunk").sortWithinPartitions(
        "chunk", "part")


def _answer_rows(t: pa.Table, blobs: list[bytes]) -> list[pa.Array]:
    return [t["chunk"].combine_chunks(), t["part"].combine_chunks(), pa.array(blobs, pa.binary())]


class State:
    """A chunk between two lengths of context.

    ``live``: places whose preceding context of the next length is to be counted;
    ``prob``: the word's probability under its longest kept context so far;
    ``score``: per document, what places that are no longer live add up to.
    Stored are the probabilities of live places, or before any context was
    judged those of the words.
    """

    KINDS = ("<i8", "u1", "<u4", "<i8", "<f8", "<f8", "<u4", "<u8", "u1", "<f4", "<f4")

    def __init__(self, blob: bytes):
        (self.doc_ids, self.null, self.lengths, self.known, self.base, self.score, self.token, self.hashes, live,
         by_word, prob) = expand(blob, *self.KINDS)
        self.live = live.astype(bool)
        self.prob = np.zeros(len(live), "<f4")
        self.prob[self.live] = by_word[self.token[self.live]] if len(by_word) else prob

    def blob(self, by_word: np.ndarray | None = None) -> bytes:
        words = np.empty(0, "<f4") if by_word is None else by_word
        return squeeze(self.doc_ids, self.null, self.lengths, self.known, self.base, self.score, self.token,
                       self.hashes, self.live.astype("u1"), words, self.prob[self.live & (not len(words))])

    def settle(self, live: np.ndarray, length: int) -> None:
        """Go on with ``live`` places for contexts of ``length``: add up the others, blank what none needs."""
        over = self.live & ~live
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.score += np.bincount(doc[over], np.log10(self.prob[over].astype("<f8")), len(self.lengths))
        self.live = live
        self.prob[~live] = 0
        needed = live.copy()
        for k in range(1, length + 1):
            needed[:-k] |= live[k:]
        self.token[~needed] = 0
        unused = np.ones(len(self.hashes), bool)
        unused[self.token] = False
        self.hashes[unused] = 0

    def keys(self, length: int) -> None:
        """The distinct (context, word) keys of one length, by context hash."""
        self.at = np.flatnonzero(self.live)
        code = np.zeros(len(self.at), "<u8")
        for k in range(1, length + 1):
            code = mix64(code + self.hashes[self.token[self.at - k]])
        self.contexts, of = np.unique(code, return_inverse=True)
        width = len(self.hashes)
        keys, self.key_of = np.unique(of.astype(np.int64) * width + self.token[self.at], return_inverse=True)
        self.key_context, self.key_word = keys // width, keys % width

    def blocks(self, parts: int, turn: int, turns: int) -> Iterator[tuple[int, bytes]]:
        """(part, block) of the parts whose turn it is: contexts, keys of each, then the keys' words, counts and probabilities."""
        learn = np.repeat([not held_out(None if n else int(k)) for k, n in zip(self.doc_ids, self.null)], self.lengths)
        count = np.bincount(self.key_of[learn[self.at]], minlength=len(self.key_word))
        prob = np.empty(len(self.key_word), "<f4")
        prob[self.key_of] = self.prob[self.at]  # a key has one probability everywhere
        many = np.bincount(self.key_context, minlength=len(self.contexts))
        part = ((self.contexts >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
        starts = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
            if part[s] % turns != turn:
                continue
            k = slice(*np.searchsorted(self.key_context, [s, e]))
            yield int(part[s]), squeeze(self.contexts[s:e], many[s:e].astype("<u4"), self.hashes[self.key_word[k]],
                                        count[k].astype("<u4"), prob[k])

    def take(self, answers: list[bytes], length: int, least: float) -> None:
        """Probabilities and the next candidates from the answers to all blocks, by part."""
        got = [expand(x, "<i8", "<i8", "<i8") for x in answers]
        alive = np.zeros(len(self.token) + 1, bool)
        if got:
            n, pull, count = (np.concatenate([g[k] for g in got]) for k in range(3))
            c, k = self.key_context[self.key_of], count[self.key_of]
            under = self.prob[self.at].astype("<f8")
            self.prob[self.at] = np.where(pull[c] > 0, (k + pull[c] * under) / np.maximum(n[c] + pull[c], 1), under)
            # a context with its word is the next word's longer context, as often in the corpus
            alive[self.at[k >= least] + 1] = True
        alive[np.cumsum(self.lengths.astype(np.int64))] = False
        self.settle(alive[:-1], length + 1)


def judge_contexts(blocks: list[bytes], min_gain: float, least: float = 0) -> list[bytes]:
    """One part's answer to each block: occurrences and different next words of contexts that
    stay (else 0), then the keys' counts (0 if below ``least`` and the context does not stay)."""
    got = [expand(b, "<u8", "<u4", "<u8", "<u4", "<f4") for b in blocks]
    contexts, of = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    owner = np.repeat(of, np.concatenate([g[1] for g in got]))
    words = np.concatenate([g[2] for g in got])
    order = np.lexsort((words, owner))
    new = np.concatenate([[True], (owner[order][1:] != owner[order][:-1]) | (words[order][1:] != words[order][:-1])])
    key = np.empty(len(words), np.int64)
    key[order] = np.cumsum(new) - 1
    c, first = owner[order][new], order[new]
    count = np.bincount(key, np.concatenate([g[3] for g in got]))
    under = np.concatenate([g[4] for g in got])[first].astype("<f8")
    n = np.bincount(c, count, len(contexts))
    pull = np.maximum(np.bincount(c, count > 0, len(contexts)), 1)
    left = (np.maximum(count - 1, 0) + pull[c] * under) / (np.maximum(n[c] - 1, 0) + pull[c])
    gain = np.bincount(c, count * (np.log(left) - np.log(under)), len(contexts))
    kept = gain > min_gain
    count = np.where(kept[c] | (count >= least), count, 0)
    n, pull, count = (x.astype("<i8") for x in (np.where(kept, n, 0), np.where(kept, pull, 0), count))
    a = np.cumsum([0, *(len(g[0]) for g in got)])
    e = np.cumsum([0, *(len(g[2]) for g in got)])
    out = []
    for i in range(len(got)):
        at = of[a[i]:a[i + 1]]
        out.append(squeeze(n[at], pull[at], count[key[e[i]:e[i + 1]]]))
    return out


def _lengthen(states: list[DataFrame], length: int, parts: int, least: float, turns: int) -> list[DataFrame]:
    """The states after contexts of ``length`` words were counted, tested and answered."""
    min_gain = MIN_GAIN

    def sent(turn: int) -> DataFrame:
        def blocks(blob: bytes) -> Iterator[tuple[int, bytes]]:
            state = State(blob)
            state.keys(length)
            return state.blocks(parts, turn, turns)

        return _by_part(_all(states), blocks)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["part"]):
            yield pa.RecordBatch.from_arrays(
                _answer_rows(t, judge_contexts(t["blob"].to_pylist(), min_gain, least)), ["chunk", "part", "blob"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["chunk"]):
            blobs = t["blob"].to_pylist()
            state = State(blobs[0])
            state.keys(length)
            state.take(blobs[1:], length, least)
            yield _state_row(t["chunk"][0].as_py(), state)

    # written on their own: the keys' shuffles are gone before the states move
    answers = [_store(sent(turn).mapInArrow(answer, "chunk string, part long, blob binary"), "answers")
               for turn in range(turns)]
    if turns == 1:
        states = [_all(states)]
    return _take_answers(states, answers, take)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written by groups of chunks (column ``grp``), and its path."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, f"llm-{name}")
    grouped = df.withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(GROUPS)).cast("int"))
    grouped.write.partitionBy("grp").parquet(path)
    return spark.read.schema(grouped.schema).parquet(path), path


def _take_answers(own: list[DataFrame], answers: list[tuple[DataFrame, str]],
                  take: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                  folder: str = "") -> list[DataFrame]:
    """What ``take`` makes of chunks and their answers.

    ``own`` is one table for each group of chunks, or one for all of them.  One
    group after the other is shuffled and replaces its table, so that no two
    copies of all chunks are on disk.  ``folder``: of a table that :func:`_store` wrote.
    """
    found, out = _all([a for a, _ in answers]), []
    spark = found.sparkSession
    for k, chunks in enumerate(own):
        mine = found if len(own) == 1 else found.where(F.col("grp") == k)
        out.append(materialize(_with_answers(chunks, mine).mapInArrow(take, _STATE), "states"))
        if folder:
            remove_path(spark, f"{folder}/grp={k}")
        else:
            remove_table(chunks)
    for _, path in answers:
        remove_path(spark, path)
    return out


_STATE = "chunk string, live long, blob binary"


def _state_row(name: str, state: State, by_word: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([int(state.live.sum())]), pa.array([state.blob(by_word)], pa.binary())],
        ["chunk", "live", "blob"])


def score(docs: DataFrame) -> DataFrame:
    """Base and suffix-tree log10 probability of every row.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  A
    null or empty text is its end alone; repeated rows all count and stay; a
    null doc_id is held out.
    """
    with lean(docs.sparkSession):
        return _score(docs)


def _score(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    chunks, chunks_path = _store(make_chunks(docs), "chunks")
    # parts grow with the corpus, so that a part's size does not
    n_parts = max(1, chunks.count() * CHUNK_BYTES // (24 * PART_ENTRIES))

    def blocks(blob: bytes) -> Iterator[tuple[int, bytes]]:
        return Chunk(blob, n_parts).blocks()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["part"]):
            blobs, totals = count_words(t["blob"].to_pylist(), t["part"][0].as_py(), n_parts)
            rest = [pa.array([x] + [0] * (len(blobs) - 1), pa.int64()) for x in totals]
            yield pa.RecordBatch.from_arrays(
                [*_answer_rows(t, blobs), *rest], ["chunk", "part", "blob", "tokens", "words", "once"])

    answers = _store(_by_part(chunks, blocks).mapInArrow(
        count, "chunk string, part long, blob binary, tokens long, words long, once long"), "counts")
    tokens, words, once = (x or 0 for x in answers[0].agg(F.sum("tokens"), F.sum("words"), F.sum("once")).first())
    unseen = (once + 0.5) / (tokens + 1)
    least = max(MIN_COUNT, MIN_SHARE * tokens)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["chunk"]):
            blobs = t["blob"].to_pylist()
            chunk = Chunk(blobs[0], n_parts)
            seen, number = (np.concatenate(x) for x in zip(*(expand(x, "<i8", "<u8") for x in blobs[1:])))
            order = np.argsort(number)  # from here on a word's place is by its number
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            token, seen, number = rank[chunk.token], seen[order], number[order]
            by_word = np.where(seen > 0, (1 - unseen) * seen / max(tokens, 1), unseen).astype("<f4")
            c = seen[token]
            base = np.log10((c + 0.1) / (tokens + 0.1 * (words + 1)))
            first = np.cumsum(chunk.lengths) - chunk.lengths
            live = np.zeros(len(c), bool)
            live[1:] = c[:-1] >= least
            live[first] = False
            state = State(squeeze(
                chunk.doc_ids, chunk.null.astype("u1"), chunk.lengths.astype("<u4"),
                np.add.reduceat((c > 0).astype("<i8"), first), np.add.reduceat(base, first), np.zeros(len(first)),
                token.astype("<u4"), number, np.ones(len(c), "u1"),
                by_word, np.empty(0, "<f4")))
            state.settle(live, 1)
            yield _state_row(t["chunk"][0].as_py(), state, by_word)

    states = _take_answers([chunks.where(F.col("grp") == k) for k in range(GROUPS)], [answers], start, chunks_path)
    remove_path(spark, chunks_path)
    for length in range(1, LONGEST + 1):
        live = _all(states).agg(F.sum("live")).first()[0]
        if not live:
            break
        # with few live places everything is small: one turn, one group
        states = _lengthen(states, length, n_parts, least, TURNS if len(states) > 1 and live > tokens / 8 else 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob"):
                s = State(blob.as_py())
                lengths = s.lengths.astype(np.int64)
                keys = [None if n else int(k) for k, n in zip(s.doc_ids, s.null)]
                s.settle(np.zeros(len(s.live), bool), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([held_out(k) for k in keys]), pa.array(lengths),
                     pa.array(s.known), pa.array(np.full(len(keys), tokens, np.int64)),
                     pa.array(s.base), pa.array(s.score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = materialize(_all(states).select("blob").mapInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double"), "scores")
    for t in states:
        remove_table(t)
    return out
