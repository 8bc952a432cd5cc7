"""Operator 8: quality rules by a hashed n-gram log-likelihood ratio.

Pieces of words (runs of letters and digits, runs of other characters) and
pairs of neighbouring pieces are hashed into ``BUCKETS`` buckets.  Two smoothed
multinomials over the buckets are counted: one from trusted documents (labelled
good and not toxic), one from the whole corpus.  A document's score is the mean
log ratio of its n-grams, so length does not matter.  Documents below a fixed
threshold, and those that fail the base rules, are rejected.

Nothing is sampled: the trusted counts cover every trusted document, the corpus
counts every document, the threshold every labelled one, and every document is
scored.  Labels meet their documents by a broadcast where they are proven small,
else by one shuffle of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import WordHasher, byte_list, mix64, slices, window_hashes
from dealflow.operators.joins import maybe_broadcast
from dealflow.operators.ordering import grouped_quantiles
from dealflow.session import checkpointed

BUCKETS = 1 << 16
MOST_CHUNKS = 300_000     # white-space chunks whose pieces a worker remembers
MIN_WORDS, MOST_REPEATED = 50, 50   # base rules: words; percent of words in repeated windows
_PIECES = re.compile(r"\w+|[^\w\s]+").findall


@dataclass(frozen=True)
class QualityModel:
    weight: np.ndarray    # log ratio of each bucket, float64
    threshold: float


class Features:
    """Bucket numbers of a text's pieces and pairs of pieces."""

    def __init__(self) -> None:
        self.known: dict[bytes, bytes] = {}

    def __call__(self, words: list[list[bytes]]) -> Iterator[np.ndarray]:
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > MOST_CHUNKS:
            self.known.clear()
            new = set().union(*words)
        digest = xxhash.xxh3_64_digest
        for w in new:
            self.known[w] = b"".join([digest(p) for p in _PIECES(w.decode().lower())])
        get = self.known.__getitem__
        for ws in words:
            one = np.frombuffer(b"".join(map(get, ws)), "<u8")
            two = mix64(one[:-1] * np.uint64(3) + one[1:])
            yield (np.concatenate([mix64(one), two]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _kinds(labels: DataFrame) -> DataFrame:
    """(doc_id, good, poor) of every labelled id that is either, stored."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.expr("quality = 1 and coalesce(toxic, 0) = 0").alias("good"),
                         F.expr("quality = 0").alias("poor"))
    return checkpointed(rows.where("doc_id is not null").groupBy("doc_id").agg(
        *[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "poor")]).where("good or poor"))


def _weights(docs: DataFrame, kinds: DataFrame) -> np.ndarray:
    """Log ratio of each bucket, from all documents and all trusted ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        total = np.zeros((2, BUCKETS), np.int64)
        for b in slices(batches, "text"):
            found = list(features([t.split() for t in byte_list(b.column("text"))]))
            own = [f for good, f in zip(b.column("good").to_pylist(), found) if good]
            for row, part in zip(total, (found, own)):
                if part:
                    row += np.bincount(np.concatenate(part), minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])],
                                         ["bucket", "raw", "target"])

    trusted = maybe_broadcast(kinds.where("good").select("doc_id", "good"))
    rows = _rows(docs).join(trusted, "doc_id", "left").select("text", "good")
    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most BUCKETS rows
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[sums["bucket"]] += sums["raw"]
    target[sums["bucket"]] += sums["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _threshold(scored: DataFrame, kinds: DataFrame) -> float:
    """Midway between the exact medians of all scored good and poor documents."""
    quality = F.explode(F.array_compact(F.array(F.when(F.col("good"), 1), F.when(F.col("poor"), 0))))
    known = checkpointed(scored.where("not base_failed").join(maybe_broadcast(kinds), "doc_id").select(
        quality.alias("quality"), "score"))
    mid = dict(grouped_quantiles(known, ["quality"], "score", [0.5], ["score"]).collect())
    return (mid[0] + mid[1]) / 2 if len(mid) == 2 else float("-inf")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Count both multinomials and set the threshold.

    ``labels``: doc_id, quality (1 good, 0 poor), toxic.  The threshold lies
    midway between the median scores of the labelled good and poor documents;
    without either kind nothing is rejected by it.
    """
    kinds = _kinds(labels)
    weight = _weights(docs, kinds)
    labelled = _rows(docs).join(maybe_broadcast(kinds.select("doc_id")), "doc_id", "left_semi")
    return QualityModel(weight, _threshold(assess(labelled, QualityModel(weight, 0.0)), kinds))


def fit_and_assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``assess(docs, fit(docs, labels))``, with every text scored once: the
    scores are stored, and the threshold is taken from those of labelled rows."""
    kinds = _kinds(labels)
    scored = checkpointed(assess(docs, QualityModel(_weights(docs, kinds), 0.0)))
    enough = F.col("score") >= F.lit(_threshold(scored, kinds))
    return scored.withColumn("kept", ~F.col("base_failed") & enough)


def _measures(text: bytes, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) >= 3:
        _, back, count = np.unique(window_hashes(words, 3), return_inverse=True, return_counts=True)
        twice = count[back] > 1
        inside = np.zeros(len(words), bool)
        for k in range(3):
            inside[k:len(words) - 2 + k] |= twice
        repeated = int(inside.sum())
    blanks = sum(map(text.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    return len(words), len(text.decode()) - blanks, symbols, len(lines) - len(set(lines)), repeated


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judge(batches: Iterator[pa.RecordBatch], weight: np.ndarray, threshold: float,
           text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    features, hasher = Features(), WordHasher(200_000)
    for b in slices(batches, text):
        texts = byte_list(b.column(text))
        words = [t.split() for t in texts]
        base = np.array([_measures(t, w) for t, w in zip(texts, hasher(words))], np.int64).reshape(-1, 5)
        score = np.array([weight[f].mean() if len(f) else 0.0 for f in features(words)])
        failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
        yield b, base, score, failed, ~failed & (score >= threshold)


def assess(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Measures, score and verdict of every row.

    doc_id (also null or repeated: one row per row), the five counts,
    base_failed, kept and score.  A null or empty text has no words: counts and
    score 0, rejected by the base rules.
    """
    weight, threshold = docs.sparkSession.sparkContext.broadcast(model.weight), model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, base, score, failed, kept in _judge(batches, weight.value, threshold, "text"):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(kept),
                 pa.array(score)], ["doc_id", *_COLUMNS, "base_failed", "kept", "score"])

    counts = ", ".join(f"{c} long" for c in _COLUMNS)
    return _rows(docs).mapInArrow(
        run, f"doc_id long, {counts}, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are; no shuffle."""
    weight, threshold = docs.sparkSession.sparkContext.broadcast(model.weight), model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _, _, kept in _judge(batches, weight.value, threshold, text):
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
