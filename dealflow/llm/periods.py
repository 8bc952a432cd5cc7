"""Operator 12: periodic runs of words, found by string synchronising sets.

A run is a maximal stretch with a smallest period q and at least 2q words (and
``least`` words).  The texts of a slice are one string of word numbers with a
number of its own behind each text, so that no run leaves its text.

* Periods up to five are read off directly: stretches where words q apart are
  equal.
* For t = 2, 4, 8, ... the places of a synchronising set are selected: of the
  windows of t words, those that are not highly periodic have a hash, and a
  place is selected if the least hash among the t + 1 windows from it stands at
  either end.  The choice depends on the 2t words from the place only.  A run
  with 3t <= q < 6t holds two selected places with equal contexts q apart, unless
  its first q words are highly periodic, so pairs of such places propose q.
  Equal contexts lie more than t/3 apart: a place has at most 18 partners.
* Highly periodic regions (period at most t/3, found at earlier scales) have no
  selected places.  A run whose halves lie in two regions of the same smaller
  period that touch is proposed from those: the periods that align them.

Every proposal is extended in both directions by comparing prefix hashes and
kept if it is long enough.  Proposals of one stretch are multiples of its
smallest period, so the least one is it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import byte_list, mix64, slices

SMALL = 5               # periods that are read off directly
LEAST = 12              # words of the shortest run
SLICE = 2 << 20         # bytes of text that are worked on together
_NONE = np.uint64(2**64 - 1)
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)  # 2147483647 and 2147483629 are prime


class PrefixHash:
    """Hashes of any stretch of words, by two prime moduli."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.parts = []
        for k, p in enumerate(_PRIMES):
            value = mix64(words.astype(np.uint64) + np.uint64(977 * k + 1)) % np.uint64(p)
            power = np.ones(n + 1, np.uint64)
            have, base = 1, int(mix64(np.array([k + 5], np.uint64))[0] % np.uint64(p))
            while have <= n:  # powers by doubling
                more = min(have, n + 1 - have)
                power[have:have + more] = power[:more] * np.uint64(pow(base, have, p)) % np.uint64(p)
                have += more
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(value * power[:n] % np.uint64(p), out=total[1:])  # below 2^31 * n
            self.parts.append((np.uint64(p), power.astype(np.uint32), (total % np.uint64(p)).astype(np.uint32)))

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words at ``a`` are those at ``b`` >= a."""
        out = np.ones(len(a), bool)
        for p, power, total in self.parts:
            x = (total[a + size].astype(np.uint64) + p - total[a]) % p
            y = (total[b + size].astype(np.uint64) + p - total[b]) % p
            out &= x * power[b - a] % p == y
        return out


def extend(hashes: PrefixHash, words: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest stretch around ``at`` in which words ``period`` apart are
    equal, as [start, end); words[at] equals words[at + period]."""
    n = len(words)
    low, high = np.zeros(len(at), np.int64), n - period - at  # words equal from at on
    while (go := low < high).any():
        mid = (low + high + 1) // 2
        same = hashes.same(at, at + period, mid)
        low, high = np.where(go & same, mid, low), np.where(go & ~same, mid - 1, high)
    end = at + low + period
    low, high = np.zeros(len(at), np.int64), at.copy()        # words equal before at
    while (go := low < high).any():
        mid = (low + high + 1) // 2
        same = hashes.same(at - mid, at - mid + period, mid)
        low, high = np.where(go & same, mid, low), np.where(go & ~same, mid - 1, high)
    return at - low, end


def _stretches(words: np.ndarray, period: int, least: int) -> np.ndarray:
    """(start, end, period) of the maximal stretches of at least ``least`` words
    in which words ``period`` apart are equal."""
    if len(words) <= period:
        return np.zeros((0, 3), np.int64)
    differ = np.flatnonzero(words[period:] != words[:-period])
    edge = np.concatenate([[-1], differ, [len(words) - period]])
    start, end = edge[:-1] + 1, edge[1:] + period
    keep = end - start >= max(least, period + 1)
    return np.column_stack([start[keep], end[keep], np.full(keep.sum(), period)])


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row for each stretch, with the least of its periods."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def _synchronising(code: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """Selected places, from the hash of the t words at each and whether those
    are highly periodic."""
    value = np.where(periodic, _NONE, code)
    least, width = value, 1
    while width < t:  # least of t windows by doubling
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    first, last = value[:len(value) - t], value[t:]
    least = np.minimum(least[:len(last)], last)
    return np.flatnonzero((least != _NONE) & ((least == first) | (least == last)))


def _pairs(place: np.ndarray, context: np.ndarray, low: int, high: int) -> np.ndarray:
    """(place, distance) of places with equal contexts ``low`` <= distance < ``high``."""
    order = np.argsort(context, kind="stable")  # places ascend already
    place, context = place[order], context[order]
    found = []
    for k in range(1, len(place)):
        gap = place[k:] - place[:-k]
        near = (context[k:] == context[:-k]) & (gap < high)
        if not near.any():
            break
        at = np.flatnonzero(near & (gap >= low))
        found.append(np.column_stack([place[at], gap[at]]))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _aligned(hashes: PrefixHash, regions: np.ndarray) -> np.ndarray:
    """(place, distance) of runs whose halves lie in two touching regions of one
    smaller period: all distances that align the two."""
    found = [np.zeros((0, 2), np.int64)]
    rows = regions[np.lexsort((regions[:, 0], regions[:, 2]))]
    a, b = rows[:-1], rows[1:]
    for (s, e, p), (s2, e2, _) in zip(*(x[(a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1])].tolist() for x in (a, b))):
        shift = np.arange(p)  # where the second region reads as the first one starts
        size = np.full(p, p)
        hit = np.flatnonzero(hashes.same(np.full(p, s), s2 + shift, size))
        if hit.size:
            gap = np.arange((s2 + int(hit[0]) - s) % p, min(e - s, e2 - s2) + 1, p)
            gap = gap[gap > SMALL]
            found.append(np.column_stack([np.maximum(s, s2 - gap), gap]))
    return np.concatenate(found)


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs of a string of word numbers.

    ``sizes`` are the lengths of its texts, each with its closing number, which
    occurs nowhere else.  Rows are ordered by start, then period.
    """
    n = len(words)
    if n < least:
        return np.zeros((0, 3), np.int64)
    # Small periods, and with them the highly periodic regions of scales 4 and 8.
    small = _smallest(np.concatenate([_stretches(words, p, max(2 * p, min(least, 4))) for p in range(1, SMALL + 1)]))
    found = [small]
    hashes = PrefixHash(words)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Only texts that can hold a run of the scale are looked at.
    at = np.arange(n)
    t, code = 1, mix64(words.astype(np.uint64) + np.uint64(1))
    while True:
        # hashes of 2t words: t words and the t behind them
        nxt = np.concatenate([code[t:], np.zeros(min(t, len(code)), np.uint64)])
        code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + nxt)
        t *= 2
        keep = sizes[owner[at]] > 6 * t
        if not keep.any():
            break
        at, code = at[keep], code[keep]
        regions = np.concatenate(found)
        regions = regions[(regions[:, 2] <= t // 3) & (regions[:, 1] - regions[:, 0] >= t)]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, regions[:, 0], 1)
        np.add.at(edge, regions[:, 1] - t + 1, -1)
        periodic = np.cumsum(edge)[at] > 0
        context = mix64(code * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([code[t:], np.zeros(min(t, len(code)), np.uint64)]))
        place = _synchronising(code, periodic, t)
        proposed = _pairs(at[place], context[place], 3 * t, 6 * t)
        if len(proposed):
            found.append(_grown(hashes, words, proposed, least))
    regions = np.concatenate(found)
    proposed = _aligned(hashes, _smallest(regions[regions[:, 1] - regions[:, 0] >= 9 * regions[:, 2]]))
    if len(proposed):
        found.append(_grown(hashes, words, proposed, least))
    out = _smallest(np.concatenate(found))
    out = out[out[:, 1] - out[:, 0] >= np.maximum(least, 2 * out[:, 2])]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _grown(hashes: PrefixHash, words: np.ndarray, proposed: np.ndarray, least: int) -> np.ndarray:
    """The stretches around proposals that are long enough for a run."""
    at, period = proposed[np.lexsort((proposed[:, 0], proposed[:, 1]))].T
    ok = words[at] == words[at + period]
    at, period = at[ok], period[ok]
    # of neighbours in one stretch the first one is enough
    head = np.ones(len(at), bool)
    chain = np.flatnonzero(period[1:] == period[:-1])
    head[chain + 1] = ~hashes.same(at[chain], at[chain] + period[chain], at[chain + 1] - at[chain])
    at, period = at[head], period[head]
    start, end = extend(hashes, words, at, period)
    long = end - start >= np.maximum(least, 2 * period)
    return np.unique(np.column_stack([start, end, period])[long], axis=0)


def repeated_tail(n: int, h: int) -> tuple[int, int] | None:
    """(first word, period) of the repetition that draw ``h`` plants in ``n`` words."""
    if n == 0 or h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def find_runs(df: DataFrame, text: str = "text", key: str = "doc_id", plant: Column | None = None,
              least: int = LEAST) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row.

    ``runs``: array of (start, length, period) in words, by start, then period:
    every stretch with smallest period q and at least max(``least``, 2q) words
    that no neighbouring word extends.  ``collapsed``: the words that no run
    contains after its first q words, joined by one space.  Words are what stands
    between ASCII white space.  ``plant``, a long: rows where it is a multiple of
    ten get a repetition planted first (see :func:`repeated_tail`), so that the
    search can be checked on any table; null plants none.  Null and empty texts
    have no words; repeated rows and null keys are kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            texts = [t.split() for t in byte_list(b.column("text"))]
            count = np.fromiter(map(len, texts), np.int64, len(texts))
            number: dict[bytes, int] = {}
            parts: list[np.ndarray] = []
            source: list[np.ndarray | None] = []
            for k, (ws, h) in enumerate(zip(texts, b.column("plant").to_pylist())):
                ids = np.fromiter([number.setdefault(w, len(number)) for w in ws], np.int64, len(ws))
                tail = repeated_tail(len(ws), h) if h is not None else None
                source.append(None)
                if tail:
                    a, p = tail
                    source[-1] = np.arange(len(ws))
                    source[-1][a:] = a + np.arange(len(ws) - a) % p
                    ids = ids[source[-1]]
                parts += [ids, np.array([-1 - k])]
            rows = runs_of(np.concatenate(parts), count + 1, least)
            starts = np.cumsum(count + 1) - count - 1
            bound = np.searchsorted(rows[:, 0], np.append(starts, len(starts) + count.sum()))
            found, collapsed = [], []
            for k, ws in enumerate(texts):
                own = rows[bound[k]:bound[k + 1]] - [starts[k], starts[k], 0]
                if source[k] is not None:
                    ws = [ws[i] for i in source[k].tolist()]
                if len(own):
                    edge = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(edge, own[:, 0] + own[:, 2], 1)
                    np.add.at(edge, own[:, 1], -1)
                    ws = [ws[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                found.append([{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()])
                collapsed.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(count), pa.array(found, _RUNS),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], ["key", "n_words", "runs", "collapsed"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"),
                     (F.lit(None) if plant is None else plant).cast("long").alias("plant"))
    return rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, "
                                "collapsed string").withColumnRenamed("key", key)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`find_runs`: n_runs, the longest run (ties:
    least start, then period; nulls if none), and SHA-256 of all runs as lines of
    ``start,length,period`` and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
        F.lit("\n"))), "")
    return found.withColumn("__best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), (-F.col("__best.start")).alias("start"),
        F.col("__best.length").alias("length"), (-F.col("__best.period")).alias("period"),
        F.floor(F.expr("1000 * __best.length / -__best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
