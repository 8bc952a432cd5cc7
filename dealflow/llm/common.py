"""Helpers shared by the operators: shared tables, Arrow slices, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.session import shared_path

# Texts are worked on in slices of at most this many bytes (one longer text
# makes a slice of its own), whatever the size of the Arrow batch.
SLICE_BYTES = 4 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage."""
    path = shared_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    col = column.cast(pa.large_binary() if large else pa.binary())
    return pc.fill_null(col, b"").to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class WordHasher:
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __init__(self, most: int = 400_000):
        self.known: dict[bytes, bytes] = {}
        self.most = most

    def __call__(self, words: list[list[bytes]]) -> list[np.ndarray]:
        """One uint64 array per list of words."""
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set().union(*words)
        digest = xxhash.xxh3_64_digest
        self.known.update((w, digest(w)) for w in new)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<u8") for ws in words]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    out = np.zeros(len(words) - width + 1, "<u8")
    for k in range(width):
        out = mix64(out + words[k:len(words) - width + 1 + k])
    return out


def block_labels(linked: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric link matrix, as its least index."""
    n = len(linked)
    label = np.full(n, -1)
    for root in range(n):
        if label[root] >= 0:
            continue
        front = np.array([root])
        while front.size:
            label[front] = root
            front = np.flatnonzero(linked[front].any(axis=0) & (label < 0))
    return label


def star_edges(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of a block: fewer edges than rows."""
    root = block_labels(linked)
    at = np.flatnonzero(root != np.arange(len(ids)))
    return ids[at], ids[root[at]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long) as (node, component).

    ``component`` is the least node reachable.  Large-star and small-star
    steps alternate until only stars are left; each step is a grouped minimum
    joined back, so a hub's neighbours never meet in one place.  Nodes without
    an edge to another node do not appear.
    """
    e = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = e.select("u", F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(
            e.select(F.col("v").alias("u"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        odd = ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
        if odd.where("leaf > 1 or (leaf = 1 and root = 1)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(small.unionByName(
            least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        remove_table(e)
        e = nxt


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches sorted by those keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cuts = [0, *new.tolist(), b.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            key = tuple(c[start] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole :func:`runs`, many at a time, and where they are cut."""

    def cuts(cols: list[np.ndarray]) -> np.ndarray:
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1

    def joined(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        return t, np.concatenate([[0], cuts([t[k].to_numpy() for k in keys]), [t.num_rows]])

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = cuts(cols)
        at = new[-1] if len(new) else 0
        if held and (at or tuple(c[0] for c in cols) != last):
            yield joined([*held, b.slice(0, at)] if at else held)
            held = []
        elif at:
            yield joined([b.slice(0, at)])
        held.append(b.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield joined(held)


def block_pairs(rows: DataFrame, group: str, item: str, n_blocks: str) -> DataFrame:
    """Deal each group's items into blocks and every pair of blocks.

    Adds ``i``, ``j`` (block pair, i <= j) and ``side`` (the row's own block):
    a row is repeated once per block of its group, so a group of any size is
    worked off in pieces of bounded size and every two of its items meet.
    """
    own = F.pmod(F.xxhash64(item), F.col(n_blocks)).cast("int")
    return rows.withColumn("side", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col(n_blocks).cast("int") - 1))).withColumn(
        "i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other")
