"""Operator 3: token ids as one compressed wavelet-matrix file per shard.

A shard holds the ids of consecutive documents (ascending doc_id).  Its file is

    magic "WMX1", uint32 levels, uint64 ids, uint64 documents
    uint64 number of zero bits of each level
    then length-prefixed zstd blocks: doc_ids (int64), ids per document
    (uint32), and each level's bit plane (least significant bit first)

Level 0 splits by the highest bit, zeros first, and so on (a wavelet matrix).
From it :class:`WaveletMatrix` answers access, rank, select, count and
occurrence lookup without the ids themselves.  Files are written by Spark's
own committer as the only value of a one-row Parquet partition, so retried or
doubled tasks leave no half-written shard and any Hadoop store will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dealflow.llm.bpe import _WORKER, ChunkEncoder, byte_characters, read_spec
from dealflow.llm.common import byte_list, slices

SHARD_TEXT = 32 << 20    # bytes of text per range partition, on average
SHARD_IDS = 16 << 20     # a partition with more ids is cut into several shards
BLOCK = 1 << 16          # ids that are moved at once
_HEAD = struct.Struct("<4sIQQ")


def _moves(bit: np.ndarray, zeros: int) -> Iterator[tuple[slice, slice, slice, np.ndarray, np.ndarray]]:
    """Block by block, a size that caches hold: the block, where its zeros and
    ones go when zeros come first, and their places in it."""
    low, high = 0, zeros
    for start in range(0, len(bit), BLOCK):
        part = slice(start, start + BLOCK)
        down, up = np.flatnonzero(~bit[part]), np.flatnonzero(bit[part])
        yield part, slice(low, low + len(down)), slice(high, high + len(up)), down, up
        low, high = low + len(down), high + len(up)


class WaveletMatrix:
    """Rank/select structure over a sequence of token ids."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], size: int):
        self.planes, self.zeros, self.size = planes, zeros, size
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        planes, zeros, cur = [], [], ids.astype("<u2" if top < 1 << 16 else "<u4")
        out = np.empty_like(cur)
        for level in reversed(range(max(top.bit_length(), 1))):
            bit = cur & cur.dtype.type(1 << level) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            zeros.append(len(bit) - int(np.count_nonzero(bit)))
            for part, low, high, down, up in _moves(bit, zeros[-1]):
                out[low], out[high] = cur[part][down], cur[part][up]
            cur, out = out, cur
        return cls(planes, zeros, len(ids))

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)

    def all_ids(self) -> np.ndarray:
        """The whole sequence, by undoing the splits from the last level up."""
        levels = len(self.planes)
        cur = self._bits(levels - 1).astype("<u2" if levels <= 16 else "<u4")
        out = np.empty_like(cur)
        for level in reversed(range(levels - 1)):
            bit, z = self._bits(level), self.zeros[level]
            cur[z:] |= cur.dtype.type(1 << (levels - 1 - level))
            for part, low, high, down, up in _moves(bit, z):
                here = out[part]
                here[down], here[up] = cur[low], cur[high]
            cur, out = out, cur
        return cur.astype("<u4")

    # One count per 64-byte block and level; the rest of a rank is a popcount.
    def _ones(self, level: int, i: int) -> int:
        if self._ranks is None:
            self._ranks = []
            for p in self.planes:
                per = np.bitwise_count(np.pad(p, (0, -len(p) % 64))).reshape(-1, 64).sum(1, dtype=np.int64)
                self._ranks.append(np.concatenate([[0], np.cumsum(per)]))
        block, rest = divmod(i, 512)
        plane = self.planes[level][block * 64:block * 64 + (rest + 7) // 8]
        full = int(np.bitwise_count(plane[:rest // 8]).sum())
        part = int(plane[-1] & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0
        return int(self._ranks[level][block]) + full + part

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level, z in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value, i = value << 1 | bit, z + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, start), self._ones(level, stop)
            up = token >> (len(self.zeros) - 1 - level) & 1
            start, stop = (z + a, z + b) if up else (start - a, stop - b)
        return start, stop

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs before position ``i``."""
        if token < 0 or token >> len(self.zeros):
            return 0
        start, stop = self._range(token, 0, i)
        return stop - start

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, 0)[0] + k
        for level in reversed(range(len(self.zeros))):
            z = self.zeros[level]
            up = i >= z
            want, low, high = (i - z if up else i), 0, self.size
            while low + 1 < high:  # the last position with that many before it
                mid = (low + high) // 2
                ones = self._ones(level, mid)
                low, high = (mid, high) if (ones if up else mid - ones) <= want else (low, mid)
            i = low
        return i

    def locate(self, token: int) -> list[int]:
        """All positions of ``token``, ascending."""
        return [self.select(token, k) for k in range(self.count(token))]


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a shard file.  A null doc_id is stored as the least int64."""
    codec = pa.Codec("zstd", compression_level=1)
    wm = WaveletMatrix.build(ids)
    null = np.iinfo(np.int64).min
    keys = np.array([null if d is None else d for d in doc_ids], "<i8")
    out = [_HEAD.pack(b"WMX1", len(wm.planes), wm.size, len(keys)), np.array(wm.zeros, "<u8").tobytes()]
    for block in (keys, np.array(lengths, "<u4"), *wm.planes):
        data = codec.compress(block.tobytes(), asbytes=True)
        out += [struct.pack("<Q", len(data)), data]
    return b"".join(out)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids, ids per document and the wavelet matrix of a shard file."""
    magic, levels, size, docs = _HEAD.unpack_from(blob)
    if magic != b"WMX1":
        raise ValueError("not a wavelet-matrix shard")
    zeros = np.frombuffer(blob, "<u8", levels, _HEAD.size).tolist()
    at, codec = _HEAD.size + 8 * levels, pa.Codec("zstd")

    def block(raw: int) -> bytes:
        nonlocal at
        (n,) = struct.unpack_from("<Q", blob, at)
        at += 8 + n
        return codec.decompress(memoryview(blob)[at - n:at], raw, asbytes=True)

    keys = np.frombuffer(block(8 * docs), "<i8")
    lengths = np.frombuffer(block(4 * docs), "<u4")
    planes = [np.frombuffer(block((size + 7) // 8), np.uint8) for _ in range(levels)]
    return keys, lengths, WaveletMatrix(planes, zeros, size)


def library_encoder(spec: str) -> ChunkEncoder:
    """Chunk encoder whose BPE is the tokenizers library's model."""
    key = ("library", hash(spec))
    if key not in _WORKER:
        tokenize = Tokenizer.from_str(spec).model.tokenize
        table = {b: c for c, b in byte_characters().items()}

        def words(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # the words in the byte-level alphabet; no word holds a line end
            texts = b"\n".join(ws).decode("latin-1").translate(table).split(table[10]) if ws else []
            size: list[int] = []
            ids: list[int] = []
            for text in texts:
                found = tokenize(text)
                size.append(len(found))
                ids += [t.id for t in found]
            return np.array(size, np.int64), np.array(ids, "<u4")

        _WORKER[key] = ChunkEncoder(spec, words)
    return _WORKER[key]


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
                 text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the shards to ``path``; returns the written table.

    Rows are dealt by range of (key, hash of the text, row), so that one key
    with many rows still spreads; null keys come first.  Every document, an
    empty or null one too, gets ``end_id``.  Columns of the table: part, sub
    (a shard's place in the order), n_docs, n_ids, shard (the file's bytes).
    An empty table writes no shard.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sub = library_encoder(spec.value), TaskContext.get().partitionId(), 0
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in ids]
            flat = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([sub], pa.int32()), pa.array([len(keys)], pa.int64()),
                 pa.array([len(flat)], pa.int64()), pa.array([pack(keys, lengths, flat)], pa.binary())],
                ["part", "sub", "n_docs", "n_ids", "shard"])

        for b in slices(batches, "text"):
            keys += b.column("key").to_pylist()
            ids += [x + end for x in encoder(byte_list(b.column("text")))]
            held += sum(map(len, ids[len(ids) - b.num_rows:])) // 4
            if held >= SHARD_IDS:
                yield shard()
                keys, ids, held, sub = [], [], 0, sub + 1
        if keys:
            yield shard()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["key", F.xxhash64("text"), "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(
        max(1, -(-volume // SHARD_TEXT)), *order).sortWithinPartitions(*order)
    dealt.select("key", "text").mapInArrow(
        run, "part int, sub int, n_docs long, n_ids long, shard binary").write.option(
        "compression", "uncompressed").parquet(path)
    return spark.read.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, sub, first): ids in all earlier shards, by two-level sums."""
    rows = shards.select("part", "sub", "n_ids", F.floor(F.col("part") / 1024).alias("grp"))
    inner = Window.partitionBy("grp").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    # one row per 1024 range partitions
    totals = rows.groupBy("grp").agg(F.sum("n_ids").alias("total"))
    outer = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("grp", F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("earlier"))
    return rows.withColumn("inside", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(before, "grp").select(
        "part", "sub", (F.col("earlier") + F.col("inside")).alias("first"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, sub, blob in zip(*(b.column(c).to_pylist() for c in ("part", "sub", "shard"))):
                keys, lengths, wm = unpack(blob)
                raw = memoryview(wm.all_ids().tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                null = keys == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), part, np.int32)), pa.array(np.full(len(keys), sub, np.int32)),
                     pa.array(keys, mask=null), pa.array(starts), pa.array(lengths.astype(np.int64)),
                     pa.array(crc, pa.int64())],
                    ["part", "sub", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "sub", "shard").mapInArrow(
        run, "part int, sub int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), ["part", "sub"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
