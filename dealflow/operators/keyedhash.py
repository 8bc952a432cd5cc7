"""MD5 of many short texts at once, and the draws made of it.

A text is a prefix, which differs from draw to draw, and a tail, which does not:
tails of one length are laid out once as 32-bit words and the 64 steps of MD5
are array operations over all of them.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# executors need no installed copy of this package: the functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AT_ONCE = 1 << 15          # texts hashed by one array operation, if a batch has fewer
MOST_ROWS = 1 << 18        # rows held before a batch is sent on
MOST_COUNTS = 1 << 22      # counts held before they are sent on

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def padded(tails: np.ndarray, before: int) -> list[np.ndarray | int]:
    """The words of ``tails`` (texts x bytes) behind ``before`` empty bytes,
    padded to whole blocks; words that all texts share are numbers."""
    total = before + tails.shape[1]
    data = np.zeros((len(tails), 64 * ((total + 8) // 64 + 1)), np.uint8)
    data[:, before:total] = tails
    data[:, total] = 0x80
    data[:, -8:] = np.frombuffer((8 * total).to_bytes(8, "little"), np.uint8)
    words = np.ascontiguousarray(data.view("<u4").T)
    return [w if before // 4 <= k <= (total - 1) // 4 and tails.shape[1] else int(w[0]) for k, w in enumerate(words)]


def _joined(heads: np.ndarray, word: np.ndarray | int) -> np.ndarray | int:
    """One word of every text of every prefix, as small as it can be."""
    if (heads == heads[0]).all():
        return word + int(heads[0]) if isinstance(word, int) else word + heads[0]
    return heads[:, None] + (np.uint32(word) if isinstance(word, int) else word)


def md5(prefixes: Sequence[bytes], words: list[np.ndarray | int], n: int) -> list[np.ndarray]:
    """The four words of the MD5 of each prefix (all of one length) with each of
    ``n`` padded tails: arrays of prefixes x tails."""
    heads = np.frombuffer(b"".join(p + bytes(-len(p) % 4) for p in prefixes), "<u4").reshape(len(prefixes), -1)
    words = [*map(_joined, heads.T, words), *words[heads.shape[1]:]]
    state = [np.full((len(prefixes), n), s, np.uint32) for s in _START]
    f, g = np.empty((2, len(prefixes), n), np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            word = words[block + _WORDS[i]]
            if isinstance(word, int):
                f += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
            else:
                f += word
                f += np.uint32(_SINES[i])
            np.left_shift(f, np.uint32(_TURNS[i]), out=g)
            np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
            f |= g
            np.add(b, f, out=a)
            a, b, c, d = d, a, b, c
        for s, x in zip(state, (a, b, c, d)):
            s += x
    return state


def _same_length(ids: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(positions, their bytes, whether they are null) of ids of each length."""
    size = pc.fill_null(pc.binary_length(ids), -1).to_numpy(zero_copy_only=False)
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        if length <= 0:
            yield at, np.zeros((len(at), 0), np.uint8), length < 0
        else:
            text = b"".join(pc.cast(ids.take(pa.array(at)), pa.binary()).to_pylist())
            yield at, np.frombuffer(text, np.uint8).reshape(len(at), -1), False


def draws(batches: Iterator[pa.RecordBatch], turns: Sequence[int], edges: Sequence[int | None], replicates: int,
          seed: int) -> Iterator[pa.RecordBatch]:
    """(_r, _z, _k, _id, _row, _n): the draws of rows (_row, _id, ...) for the
    replicates 2t and 2t + 1 of every turn t, halves of one MD5 of (seed, t, id).

    ``edges`` are the leading 32 bits where zones begin, None the end of the
    range.  Draws in zones with odd numbers are rows, those in the others are
    only counted.  ``_k`` sorts like the draw.
    """
    names = ["_r", "_z", "_k", "_id", "_row", "_n"]
    lows = [None if e is None else np.uint32(e) for e in edges]
    replicate = np.array([2 * t + i for t in turns for i in (0, 1)], np.int32)
    known: dict = {}
    totals = np.zeros((0, len(replicate), len(edges) // 2 + 1), np.int64)
    held: list[tuple] = []

    def rows_of(held: list[tuple], ids: pa.Array, groups: pa.Array) -> pa.RecordBatch:
        r, z, k, at = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array(r), pa.array(z), pa.array(k), ids.take(pa.array(at)), groups.take(pa.array(at)),
             pa.array(np.ones(len(at), np.int64))], names)

    def counts_of(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        values = list(known)
        for g in range(len(values)):
            r, z = np.nonzero(totals[g])
            none = pa.nulls(len(r), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(replicate[r]), pa.array((2 * z).astype(np.int32)), pa.nulls(len(r), pa.int64()), none,
                 pa.array([values[g]], kind).take(pa.array(np.zeros(len(r), np.int64))), pa.array(totals[g][r, z])], names)

    def pieces() -> Iterator[pa.RecordBatch]:
        most = max(1, MOST_COUNTS // (len(replicate) * (len(edges) // 2 + 1)))
        for b in batches:
            step = max(b.num_rows, 1) if pc.count_distinct(b.column("_row"), mode="all").as_py() <= most else most
            for start in range(0, b.num_rows, step):
                yield b.slice(start, step)

    for batch in pieces():
        ids, groups = batch.column("_id"), batch.column("_row")
        coded = pc.dictionary_encode(groups, null_encoding="encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        values = coded.dictionary.to_pylist()
        if known and (len(known) + len(values)) * totals[0].size > MOST_COUNTS:
            yield from counts_of(groups.type)
            known, totals = {}, totals[:0]
        number = np.array([known.setdefault(v, len(known)) for v in values], np.int64)
        totals = np.concatenate([totals, np.zeros((len(known) - len(totals), *totals.shape[1:]), np.int64)])
        waiting = 0
        for at, tails, null in _same_length(ids):
            order = np.argsort(code[at], kind="stable")
            at, tails = at[order], tails[order]
            own = number[code[at]]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            group, full = own[starts], np.diff([*starts, len(at)])
            laid: dict[int, list] = {}
            first, most = 0, max(1, AT_ONCE // len(at))
            while first < len(turns):
                some = [t for t in turns[first:first + most] if len(str(t)) == len(str(turns[first]))]
                prefixes = [f"{seed}:{t}{'' if null else ':'}".encode() for t in some]
                if len(prefixes[0]) not in laid:
                    laid[len(prefixes[0])] = padded(tails, len(prefixes[0]))
                words = md5(prefixes, laid[len(prefixes[0])], len(at))
                for i in (0, 1):
                    # an odd number of replicates leaves the last half of a hash out
                    dealt = sum(2 * t + i < replicates for t in some)
                    places = 2 * np.arange(first, first + dealt) + i
                    high, low = words[2 * i][:dealt].byteswap(), words[2 * i + 1][:dealt]
                    below = [high < e if e is not None else np.ones(high.shape, bool) for e in lows]
                    counts = [np.add.reduceat(b, starts, axis=1, dtype=np.int64) for b in below] if dealt else []
                    for z in range(0, len(edges) + 1, 2) if dealt else ():
                        upto = full if z == len(edges) else counts[z]
                        totals[np.ix_(group, places, [z // 2])] += (upto - (counts[z - 1] if z else 0)
                                                                    ).T.reshape(len(group), dealt, 1)
                    for z in range(1, len(edges), 2):
                        row, found = np.nonzero(below[z] & ~below[z - 1])
                        k = high[row, found].astype(np.uint64) << np.uint64(32) | low[row, found].byteswap()
                        held.append((replicate[places[row]], np.full(len(row), z, np.int32),
                                     (k ^ np.uint64(1 << 63)).view(np.int64), at[found]))
                        waiting += len(row)
                    if waiting >= MOST_ROWS:
                        yield rows_of(held, ids, groups)
                        held, waiting = [], 0
                first += len(some)
        if held:
            yield rows_of(held, ids, groups)
            held = []
    if known:
        yield from counts_of(groups.type)
