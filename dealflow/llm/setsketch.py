"""Operator 4: near-duplicate documents with SetSketch registers.

1.  Each document's set of word shingles is sketched: every shingle throws
    points of a Poisson process, each point labelled with a register, and a
    register keeps its least point on an exponentially spaced, truncated scale
    (one byte).  Registers of a union are the maxima of the registers.
2.  Equal sets form one class, represented by its least doc_id.
3.  Bands of register values are keys.  The similarity of every two classes
    that share a key is estimated by maximum likelihood from their greater /
    less / equal register counts and set sizes; connected pairs estimated at
    ``FLOOR`` or more make groups.  A shared key alone ties nothing: texts with
    one passage in common share keys across the whole corpus.
4.  Within a group, block by block, every two classes are estimated, and pairs
    at ``FLOOR`` or more are confirmed on the full sets.  A block yields a
    spanning star of its links, never pairs, and so does a block of a key.
5.  Connected links make the components.

With 59 bands of 6 registers two sets at similarity 0.75 meet in no band with
probability below 2e-5, more similar ones far less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import (WordHasher, block_pairs, byte_list, components, materialize, mix64, runs, slices,
                                 star_edges, whole_runs, window_hashes)

WIDTH = 5                 # words per shingle
BANDS, ROWS = 59, 6
REGISTERS = BANDS * ROWS
BASE, RATE = 1.1, 20.0    # spacing of the register scale; rate of the minima
FLOOR = 0.6               # likelihood estimates below are not confirmed (over 6 standard errors)
BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCK_SHINGLES = 128, 2048, 2_000_000
FEW_ROWS = 32             # shared keys with up to so many classes are compared many at a time

_STEP, _LABEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_POINTS = math.ceil(REGISTERS * (math.log(REGISTERS) + 5))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(WIDTH, len(words))))


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint8) of a non-empty set of 64-bit hashes."""
    least = np.full(REGISTERS, np.inf)
    step = max(1, -(-_POINTS // len(items)))
    reached, done, live = np.zeros(len(items)), 0, items
    while live.size:
        count = np.arange(done + 1, done + step + 1, dtype=np.uint64)
        draw = mix64(live[:, None] + count * _STEP)
        gap = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53)
        gap[:, 0] += reached
        point = np.cumsum(gap, axis=1)
        np.minimum.at(least, (mix64(draw ^ _LABEL) % np.uint64(REGISTERS)).astype(np.intp).ravel(), point.ravel())
        on = point[:, -1] < least.max()
        live, reached, done = live[on], point[on, -1], done + step
    value = np.floor(1 - np.log(least / (REGISTERS * RATE)) / math.log(BASE))
    return np.clip(value, 0, 255).astype(np.uint8)


def compared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many registers of every row of ``a`` are greater than those of every
    row of ``b``, and how many are less."""
    if len(a) * len(b) < 4096:
        return (a[:, None] > b).sum(2), (a[:, None] < b).sum(2)
    more, less = np.zeros((2, len(a), len(b)), np.uint16)
    flag, columns = np.empty((len(a), len(b)), bool), np.ascontiguousarray(b.T)
    for start in range(0, REGISTERS, 255):  # as many as a byte counts
        up, down = np.zeros((2, len(a), len(b)), np.uint8)
        for k in range(start, min(start + 255, REGISTERS)):
            up += np.greater(a[:, k, None], columns[k], out=flag).view(np.uint8)
            down += np.less(a[:, k, None], columns[k], out=flag).view(np.uint8)
        more += up
        less += down
    return more, less


def _slope(j: np.ndarray, more: np.ndarray, less: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How the log likelihood of similarity ``j`` rises; ``u`` is the first set's
    part of both sizes.  The likelihood is concave."""
    v, rate, tiny = 1 - u, (BASE - 1) / BASE, 1e-300
    x, y = 1 - rate * np.maximum(u - v * j, 0), 1 - rate * np.maximum(v - u * j, 0)
    p, q = -np.log(x) / math.log(BASE), -np.log(y) / math.log(BASE)
    dp, dq = v * rate / (x * math.log(BASE)), u * rate / (y * math.log(BASE))
    return ((REGISTERS - more - less) * (dp + dq) / np.maximum(1 - p - q, tiny)
            - more * dp / (p + tiny) - less * dq / (q + tiny))


def _estimate(more: np.ndarray, less: np.ndarray, u: np.ndarray) -> np.ndarray:
    low, high = np.zeros_like(u), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(20):
        middle = (low + high) / 2
        up = _slope(middle, more, less, u) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2


def joint_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of every row of ``a`` with every one of ``b``."""
    more, less = (c.astype(float) for c in compared(a, b))
    return _estimate(more, less, size_a[:, None] / (size_a[:, None] + size_b))


def _reaches(more: np.ndarray, less: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Which estimates are ``FLOOR`` or more.  Where the likelihood falls at
    ``FLOOR``, or sizes differ too much, the estimate is less: it is not sought."""
    out = np.minimum(u / (1 - u), (1 - u) / u) >= FLOOR
    for judge in (lambda *c: _slope(FLOOR, *c) >= 0, lambda *c: _estimate(*c) >= FLOOR):
        at = np.nonzero(out)
        out[at] = judge(more[at].astype(float), less[at].astype(float), u[at])
    return out


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` are estimated at ``FLOOR`` or more with which of ``b``."""
    out = np.zeros((len(a), len(b)), bool)
    step = max(1, (1 << 17) // max(len(b), 1))
    for k in range(0, len(a), step):
        size = size_a[k:k + step, None]
        out[k:k + step] = _reaches(*compared(a[k:k + step], b), size / (size + size_b))
    return out


def links(sets_a: list[np.ndarray], regs_a: np.ndarray, sets_b: list[np.ndarray], regs_b: np.ndarray,
          percent: int = 75) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, confirmed on the sets."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    maybe = likely(regs_a, regs_b, size_a, size_b)
    out = np.zeros(maybe.shape, bool)
    cols = np.flatnonzero(maybe.any(axis=0))
    if not cols.size:
        return out
    words, codes = np.unique(np.concatenate([*(sets_b[c] for c in cols), *sets_a]), return_inverse=True)
    split = int(size_b[cols].sum())
    flat, starts = codes[:split], np.concatenate([[0], np.cumsum(size_b[cols])[:-1]])
    own = np.split(codes[split:], np.cumsum(size_a)[:-1])
    mark = np.zeros(len(words), np.int64)
    for r in np.flatnonzero(maybe.any(axis=1)):
        mark[own[r]] = 1
        common = np.add.reduceat(mark[flat], starts)
        mark[own[r]] = 0
        union = size_a[r] + size_b[cols] - common
        out[r, cols] = maybe[r, cols] & (100 * common >= percent * union)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hasher = WordHasher()
    for b in slices(batches, "text"):
        yield b, [shingles(w) for w in hasher([t.lower().split() for t in byte_list(b.column("text"))])]


def sketch(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, set_hash, registers); the last two null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "set_hash", "registers"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_hash binary, registers binary")


def shared_bands(classes: DataFrame) -> DataFrame:
    """(class, band, n_blocks): classes by the bands that several of them share;
    of bands with the same classes one."""
    keys = [F.xxhash64(F.lit(k), F.substring("registers", k * ROWS + 1, ROWS)) for k in range(BANDS)]
    rows = classes.select("class", F.explode(F.array(*keys)).alias("band"))
    same = rows.groupBy("band").agg(F.count("*").alias("c"), F.bit_xor("class").alias("x"), F.min("class").alias("m"))
    one = same.where("c > 1").groupBy("c", "x", "m").agg(F.min("band").alias("band"))
    return rows.join(one.select("band", F.ceil(F.col("c") / MOST_BLOCK_ROWS).alias("n_blocks")), "band")


def _likely_star(ids: np.ndarray, regs: np.ndarray, size: np.ndarray, one: np.ndarray,
                 two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the likely pairs between two sides (or within one).

    What is likely with the first row is connected: of the other pairs, those
    with a row that is not are compared.
    """
    linked = np.zeros((len(ids), len(ids)), bool)

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        if len(x) and len(y):
            found = likely(regs[x], regs[y], size[x], size[y])
            linked[np.ix_(x, y)] |= found
            linked[np.ix_(y, x)] |= found.T

    compare(one[:1], np.arange(len(ids)))
    near = linked[one[0]]
    compare(one[~near[one]], two)
    if one is not two:
        compare(one[near[one]], two[~near[two]])
    return star_edges(ids, linked)


def _few_links(ids: np.ndarray, regs: np.ndarray, size: np.ndarray, starts: np.ndarray,
               ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the likely pairs within each of many short runs."""
    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)])
    later = np.repeat(ends, ends - starts) - rows - 1
    x = np.repeat(rows, later)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
    ok = np.zeros(len(x), bool)
    for k in range(0, len(x), 8192):
        i, j = x[k:k + 8192], y[k:k + 8192]
        a, b = regs[i], regs[j]
        ok[k:k + 8192] = _reaches((a > b).sum(1), (a < b).sum(1), size[i] / (size[i] + size[j]))
    x, y, root = x[ok], y[ok], np.arange(len(ids))
    while (root[x] != root[y]).any():
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
    at = np.flatnonzero(root != np.arange(len(ids)))
    return ids[at], ids[root[at]]


def likely_links(classes: DataFrame) -> DataFrame:
    """Spanning links (a, b) of the likely pairs among the classes of each band.

    ``classes``: class, rep, n_shingles, registers.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_runs(batches, ["band", "i", "j"]):
            ids, size = t["rep"].to_numpy(), t["n_shingles"].to_numpy()
            regs = np.frombuffer(b"".join(t["registers"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
            side, i, j = (t[c].to_numpy() for c in ("side", "i", "j"))
            starts, ends = cuts[:-1], cuts[1:]
            few = ends - starts <= FEW_ROWS
            found = [_few_links(ids, regs, size, starts[few], ends[few])] if few.any() else []
            for s, e in zip(starts[~few], ends[~few]):
                own = side[s:e]
                one = np.flatnonzero(own == i[s])
                two = one if i[s] == j[s] else np.flatnonzero(own == j[s])
                if len(one) and len(two):
                    found.append(_likely_star(ids[s:e], regs[s:e], size[s:e], one, two))
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # one plan at every size: the number of shared bands grows with the corpus
    rows = shared_bands(classes).join(classes.hint("merge"), "class")
    sort = ["band", "i", "j"]
    # by rep too: a link leads to the least, which is the same in most bands
    return block_pairs(rows, "band", "class", "n_blocks").select(
        *sort, "side", "rep", "n_shingles", "registers").repartition(*sort).sortWithinPartitions(
        *sort, "rep").mapInArrow(check, "a long, b long").where("a <> b").distinct()


def confirmed(members: DataFrame) -> DataFrame:
    """Spanning links (a, b) of the true links within each group.

    ``members``: rep, text, grp.
    """

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches):
            keep = [k for k, s in enumerate(sets) if len(s)]
            rows = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("rep"), rows.column("grp"),
                 pa.array([len(sets[k]) for k in keep], pa.int64()),
                 pa.array([sets[k].tobytes() for k in keep], pa.binary()),
                 pa.array([registers(sets[k]).tobytes() for k in keep], pa.binary())],
                ["rep", "grp", "n", "items", "registers"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["grp", "i", "j"]):
            ids = t["rep"].to_numpy()
            sets = [np.frombuffer(x, "<u8") for x in t["items"].to_pylist()]
            regs = np.array([np.frombuffer(x, np.uint8) for x in t["registers"].to_pylist()])
            i, j = t["i"][0].as_py(), t["j"][0].as_py()
            one = np.flatnonzero(t["side"].to_numpy() == i)
            two = one if i == j else np.flatnonzero(t["side"].to_numpy() == j)
            if not len(one) or not len(two):
                continue
            linked = np.zeros((len(ids), len(ids)), bool)
            found = links([sets[k] for k in one], regs[one], [sets[k] for k in two], regs[two])
            linked[np.ix_(one, two)] = found
            linked[np.ix_(two, one)] |= found.T
            a, b = star_edges(ids, linked)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = materialize(members.select("rep", "grp", "text").mapInArrow(
        prepare, "rep long, grp long, n long, items binary, registers binary"), "sets")
    wide = F.least(F.greatest(F.col("c") / 16, F.lit(BLOCK_ROWS)), F.lit(MOST_BLOCK_ROWS))
    blocks = rows.groupBy("grp").agg(F.count("*").alias("c"), F.sum("n").alias("s")).where("c > 1").select(
        "grp", F.ceil(F.greatest(F.col("c") / wide, F.col("s") / BLOCK_SHINGLES)).alias("n_blocks"))
    dealt = block_pairs(rows.join(blocks, "grp"), "grp", "rep", "n_blocks")
    sort = ["grp", "i", "j"]
    return dealt.select(*sort, "side", "rep", "items", "registers").repartition(*sort).sortWithinPartitions(
        *sort).mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.
    Documents with a null doc_id take no part: component_id is null and kept
    true.  Documents without words are linked with nothing.  Rows that repeat a
    doc_id share what the id is linked with; repeated rows all stay.
    """
    sketches = materialize(sketch(docs, text, key), "sketches")
    full = sketches.where("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("set_hash").agg(
        F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("registers").alias("registers")).withColumn("class", F.xxhash64("set_hash")).drop("set_hash")
    groups = components(likely_links(materialize(classes, "classes")))
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    # one plan at every size: the number of candidates grows with the corpus
    members = texts.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")).hint("merge"), "rep")
    found = components(confirmed(members))
    final = full.groupBy("set_hash").agg(F.min("doc_id").alias("rep")).join(
        found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "set_hash").join(final, "set_hash", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
