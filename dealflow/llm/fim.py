"""Operator 11: fill-in-the-middle transformation cut by a wavelet matrix.

Every byte of a text has one of eight classes: where a word begins, what else is
in it, white space, line ends, and bytes inside a character.  A wavelet matrix
over the classes (three bit planes with counts) answers how many bytes of a
class lie before a place.  Units (characters, words, lines) begin or end at some
classes, so the units before a place are a sum of ranks, and the place of a cut
after so many units is found by bisection on these sums: for all texts of a
slice at once, without a list of positions.

The matrix is kept in blocks of ``BLOCK`` bytes, so that building it takes the
same memory for a text of any length; the planes themselves take half a byte for
each byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import byte_list, slices

BLOCK = 1 << 20  # bytes; a multiple of 64
LEVELS = 3
# Classes of bytes.
INSIDE, LINE_END, SPACE, WORD, WORD_LEAD, REST, REST_LEAD = range(7)
# Units: the classes that mark one, and whether it ends behind the mark (a line
# does) or begins there.
UNITS = {"characters": ((LINE_END, SPACE, WORD, WORD_LEAD, REST, REST_LEAD), False),
         "words": ((WORD, WORD_LEAD), False),
         "lines": ((LINE_END,), True)}
MARKERS = (b"<P>", b"<S>", b"<M>")


def _kinds() -> np.ndarray:
    kind = np.full(256, REST, np.uint8)
    kind[0x80:0xC0], kind[0xC0:] = INSIDE, REST_LEAD
    kind[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], kind[0x0A] = SPACE, LINE_END
    return kind


_KINDS = _kinds()


def byte_classes(text: np.ndarray, before: int, starts: np.ndarray) -> np.ndarray:
    """Class of each byte of a stretch.

    ``before`` is the byte in front of it, ``starts`` the places in it where a
    text starts, so that a word begins there whatever stands in front.
    """
    kind = _KINDS[text]
    blank = (kind == SPACE) | (kind == LINE_END)
    first = np.append(_KINDS[before] in (SPACE, LINE_END), blank[:-1])
    first[starts] = True
    first &= ~blank & (kind != INSIDE)
    kind[first] -= REST - WORD
    return kind


class ClassMatrix:
    """Wavelet matrix over the byte classes of texts that follow each other."""

    def __init__(self, data: bytes, starts: np.ndarray):
        self.size = len(data)
        blocks = max(1, -(-self.size // BLOCK))
        per = BLOCK // 64 if blocks > 1 else max(1, -(-self.size // 64))
        # Bits of each level and block, ones before each 64 of them, zeros of a block.
        self.bits = np.zeros((LEVELS, blocks, per), np.uint64)
        self.ones = np.zeros((LEVELS, blocks, per), np.int32)
        self.zeros = np.zeros((LEVELS, blocks), np.int64)
        # Of each class: where its bytes begin in the last level, and its bytes in earlier blocks.
        self.first = np.zeros((1 << LEVELS, blocks), np.int64)
        self.earlier = np.zeros((1 << LEVELS, blocks + 1), np.int64)
        text = np.frombuffer(data, np.uint8)
        for k, at in enumerate(range(0, self.size, BLOCK)):
            here = starts[np.searchsorted(starts, at):np.searchsorted(starts, at + BLOCK)] - at
            part = text[at:at + BLOCK]
            cur = byte_classes(part, data[at - 1] if at else 0x20, here[here < len(part)])
            count = np.bincount(cur, minlength=1 << LEVELS)
            self.earlier[:, k + 1] = self.earlier[:, k] + count
            for level in range(LEVELS):
                bit = (cur >> (LEVELS - 1 - level) & 1).astype(bool)
                packed = np.zeros(per * 8, np.uint8)
                raw = np.packbits(bit, bitorder="little")
                packed[:len(raw)] = raw
                words = packed.view("<u8")
                self.bits[level, k] = words
                self.ones[level, k, 1:] = np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int32)
                self.zeros[level, k] = len(bit) - int(bit.sum())
                cur = np.concatenate([cur[~bit], cur[bit]])
            # classes lie in the last level in the order of their reversed bits
            begin = 0
            for c in sorted(range(1 << LEVELS), key=lambda c: f"{c:0{LEVELS}b}"[::-1]):
                self.first[c, k] = begin
                begin += count[c]

    def _ones_before(self, level: int, block: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = np.minimum(at >> 6, self.bits.shape[2] - 1)
        rest = (at - (word << 6)).astype(np.uint64)
        mask = np.where(rest < 64, (np.uint64(1) << (rest & np.uint64(63))) - np.uint64(1), ~np.uint64(0))
        return self.ones[level, block, word] + np.bitwise_count(self.bits[level, block, word] & mask).astype(np.int64)

    def rank(self, kind: int, at: np.ndarray) -> np.ndarray:
        """Bytes of class ``kind`` before each place."""
        block = np.minimum(at // BLOCK, self.bits.shape[1] - 1)
        pos = at - block * BLOCK
        for level in range(LEVELS):
            ones = self._ones_before(level, block, pos)
            pos = self.zeros[level, block] + ones if kind >> (LEVELS - 1 - level) & 1 else pos - ones
        return self.earlier[kind, block] + pos - self.first[kind, block]

    def marks(self, kinds: Sequence[int], at: np.ndarray) -> np.ndarray:
        """Bytes of any of the classes before each place: a sum of ranks, of
        these classes or of all others, whichever are fewer."""
        others = [c for c in range(REST_LEAD + 1) if c not in kinds]
        if len(others) < len(kinds):
            return at - sum((self.rank(c, at) for c in others), np.zeros(len(at), np.int64))
        return sum((self.rank(c, at) for c in kinds), np.zeros(len(at), np.int64))

    def units(self, unit: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Units of each text.  White space before the first word belongs to it;
        what follows the last line end is a line unless it is empty."""
        kinds, behind = UNITS[unit]
        n = self.marks(kinds, end) - self.marks(kinds, start)
        if behind:
            closed = self.marks(kinds, end) - self.marks(kinds, np.maximum(end - 1, start))
            n = n + ((end > start) & (closed == 0))
        return n

    def cut(self, unit: str, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where each text's first ``k`` units end."""
        kinds, behind = UNITS[unit]
        # The place wanted is the least one with so many marks before it; one
        # step back from the mark of the next unit where units begin at marks.
        want = self.marks(kinds, start) + k + (0 if behind else 1)
        low, high = start.copy(), end.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            reached = self.marks(kinds, mid) >= want
            high = np.where(open_ & reached, mid, high)
            low = np.where(open_ & ~reached, mid + 1, low)
        if not behind:  # no next unit: the end
            low = np.where(self.marks(kinds, end) >= want, low - 1, end)
        return np.where(k == 0, start, low)


def draws(key: Column) -> list[Column]:
    """Four unsigned 32-bit draws of a row: the first hex digits of the SHA-256
    of ``1:`` and the key in decimal.  A null key counts as an empty string."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "characters",
              rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """Cut every text twice and order the parts for filling in the middle.

    Of the four draws of a row, the first two modulo (units + 1) are the cuts, the
    third decides whether the row is transformed (``rate`` percent) and the
    fourth whether the suffix leads (``spm_rate`` percent: ``spm``, else
    ``psm``).  Returns (key, n, form, prefix_chars, middle_chars, output): units
    of the text, the units of prefix and middle (null if ``plain``) and the
    text made.  Null texts are empty ones; empty texts, and those that hold a
    marker, are plain.  Repeated rows and null keys are kept; rows that share a
    key share their draws.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = byte_list(b.column("text"))
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            end = np.cumsum(size)
            start = end - size
            index = ClassMatrix(b"".join(texts), start)
            n = index.units(unit, start, end)
            h = [b.column(f"h{i}").to_numpy() for i in range(1, 5)]
            first, second = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
            c1, c2 = (index.cut(unit, start, end, k) - start for k in (first, second))
            whole = (h[2] % 100 >= rate) | (n == 0)
            leads = h[3] % 100 < spm_rate
            forms, made = [], []
            for t, p, m, w, s in zip(texts, c1.tolist(), c2.tolist(), whole.tolist(), leads.tolist()):
                if w or any(x in t for x in MARKERS):
                    forms.append("plain")
                    made.append(t)
                elif s:
                    forms.append("spm")
                    made.append(b"<S>" + t[m:] + b"<P>" + t[:p] + b"<M>" + t[p:m])
                else:
                    forms.append("psm")
                    made.append(b"<P>" + t[:p] + b"<S>" + t[m:] + b"<M>" + t[p:m])
            form = pa.array(forms, pa.string())
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(n), form, pa.array(first, mask=plain),
                 pa.array(second - first, mask=plain), pa.array(made, pa.binary()).cast(pa.string())],
                ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"),
                     *[h.alias(f"h{i}") for i, h in enumerate(draws(df[key]), 1)])
    return rows.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, "
                                "output string").withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.  A transformed text holds no
    marker of its own, so the three that are there part it."""
    first, second, third = (F.get(F.split(output, "<[PSM]>", -1), F.lit(k)) for k in (1, 2, 3))
    return (F.when(form == "psm", F.concat(first, third, second))
            .when(form == "spm", F.concat(second, third, first)).otherwise(output))
