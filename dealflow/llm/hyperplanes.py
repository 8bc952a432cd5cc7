"""Operator 7: near-duplicate embeddings by random-hyperplane sign hashing.

Each vector gets, in each of ``tables`` tables, a key of ``bits`` signs of its
products with random directions.  Vectors that share a key are compared by
exact cosine in double precision, bucket by bucket, large buckets in pairs of
blocks.  A pair is counted in the first table whose key it shares, so counts
need no list of pairs; a block yields link counts and a spanning star of its
links.  Equal vectors form one class first and are counted, not paired.

Two vectors at cosine c share a key of a table with probability
``(1 - acos(c) / pi) ** bits``: with 12 bits and 48 tables a pair at 0.9 is
missed with probability 3e-4, at 0.95 with 2e-7.  Raise both for far more than
ten million vectors (:func:`tables_for`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import block_pairs, components, materialize, runs, star_edges

BITS, TABLES, SEED = 12, 48, 20240229
BLOCK_ROWS = 512


def tables_for(bits: int, cosine: float, miss: float) -> int:
    """Tables needed so that a pair at ``cosine`` is missed with at most ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(1 - math.acos(cosine) / math.pi) ** bits))


def directions(size: int, bits: int, tables: int) -> np.ndarray:
    """The same random directions on every worker."""
    return np.random.default_rng([SEED, size]).standard_normal((size, bits * tables))


def unit_vectors(vecs: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; huge and tiny components keep a finite length."""
    scaled = vecs.astype(float) / np.abs(vecs).max(axis=1).astype(float)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def key_type(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4"


def keyed_rows(batches: Iterator[pa.RecordBatch], bits: int, tables: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The valid vectors (in their own precision) and their table keys, by length."""
    powers = 1 << np.arange(bits)
    for b in batches:
        rows = [(i, np.array([np.nan if x is None else x for x in v], float))
                for i, v in zip(b.column("id").to_pylist(), b.column("vec").to_pylist()) if v and i is not None]
        for size in {len(v) for _, v in rows}:
            ids = [i for i, v in rows if len(v) == size]
            vecs = np.array([v for _, v in rows if len(v) == size]).astype(kind) + np.dtype(kind).type(0)  # no -0
            top = np.abs(vecs).max(axis=1)
            ok = np.isfinite(top) & (top > 0)
            unit = unit_vectors(vecs[ok])
            sign = (unit @ directions(size, bits, tables) > 0).reshape(len(unit), tables, bits)
            keys = (sign * powers).sum(2).astype(key_type(bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, k in zip(ids, ok) if k], pa.int64()),
                 pa.array([v.tobytes() for v in vecs[ok]], pa.binary()),
                 pa.array([k.tobytes() for k in keys], pa.binary())], ["id", "raw", "keys"])


def compare(batches: Iterator[pa.RecordBatch], cosine: float, bits: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Per block pair: (a, null, links) counts and (a, b, null) star edges."""
    for t in runs(batches, ["tab", "bucket", "size", "i", "j"]):
        tab, i, j = (t[c][0].as_py() for c in ("tab", "i", "j"))
        ids, side = t["rep"].to_numpy(), t["side"].to_numpy()
        unit = unit_vectors(np.array([np.frombuffer(x, kind) for x in t["raw"].to_pylist()]))
        keys = np.array([np.frombuffer(x, key_type(bits)) for x in t["keys"].to_pylist()])
        one = np.flatnonzero(side == i)
        two = one if i == j else np.flatnonzero(side == j)
        near = unit[one] @ unit[two].T >= cosine
        if i == j:
            np.fill_diagonal(near, False)
        r, c = np.nonzero(near)
        if not len(r):
            continue
        for s in range(0, len(r), 1 << 16):  # leave out pairs met in an earlier table
            rs, cs = r[s:s + (1 << 16)], c[s:s + (1 << 16)]
            met = (keys[one[rs], :tab] == keys[two[cs], :tab]).any(axis=1)
            near[rs[met], cs[met]] = False
        linked = np.zeros((len(ids), len(ids)), bool)
        linked[np.ix_(one, two)] = near
        linked[np.ix_(two, one)] |= near.T
        copies = t["copies"].to_numpy()
        count = linked @ copies
        at = np.flatnonzero(count)
        a, b = star_edges(ids, linked)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[at], a])), pa.array([None] * len(at) + b.tolist(), pa.int64()),
             pa.array(count[at].tolist() + [None] * len(a), pa.int64())], ["a", "b", "links"])


def near_vectors(df: DataFrame, vec: str = "embedding", key: str = "vec_id", cosine: float = 0.9,
                 bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different lengths with each other.
    Rows with a null id take no part (component_id null, kept true).  A row
    that repeats an id with the same vector counts as one more copy.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"))
    kind = "<f4" if df.schema[vec].dataType.elementType.typeName() == "float" else "<f8"
    valid = materialize(rows.mapInArrow(
        lambda it: keyed_rows(it, bits, tables, kind), "id long, raw binary, keys binary"), "vectors")
    members = valid.groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("copies"),
                                       F.any_value("keys").alias("keys"))
    members = materialize(members, "vector-classes")
    wide = np.dtype(key_type(bits)).itemsize
    placed = members.withColumn("size", F.length("raw")).withColumn(
        "tab", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    placed = placed.withColumn("bucket", F.xxhash64(F.substring("keys", F.col("tab") * wide + 1, F.lit(wide))))
    spot = ["tab", "bucket", "size"]
    full = placed.groupBy(*spot).agg(F.count("*").alias("c")).where("c > 1").select(
        *spot, F.ceil(F.col("c") / BLOCK_ROWS).alias("n_blocks"))
    sort = [*spot, "i", "j"]
    found = materialize(block_pairs(placed.join(full, spot), "bucket", "rep", "n_blocks").select(
        *sort, "side", "rep", "copies", "raw", "keys").repartition(*sort).sortWithinPartitions(*sort).mapInArrow(
        lambda it: compare(it, cosine, bits, kind), "a long, b long, links long"), "vector-links")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comp = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    by_class = members.select("raw", "rep", "copies").join(links, "rep", "left").join(comp, "rep", "left").select(
        "raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("component", "rep").alias("component"))
    by_row = valid.select("id", "raw").join(by_class, "raw").groupBy("id").agg(
        F.max("n").alias("n"), F.min("component").alias("component"))
    out = rows.select("id").join(by_row, "id", "left")
    comp_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).alias("n_links"),
                      comp_id.alias("component_id"), F.coalesce(comp_id == F.col("id"), F.lit(True)).alias("kept"))
