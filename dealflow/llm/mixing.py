"""Operator 6: mixing sources to target weights by raking, then sampling.

Token mass is summed per cell (source, language, topic).  Iterative
proportional fitting scales the cell weights until the weight of every source,
language and topic meets its target.  A document of a cell is then drawn with
probability ``min(1, k * weight / mass)``, with ``k`` solved so that the
expected tokens meet the budget.  Draws depend on the document alone.

The topic is lexical: distinct long words fall into ``TOPICS`` hash buckets
and the fullest bucket (least number on ties) names the topic.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import byte_list, materialize, remove_table, slices

TOPICS, LONG_WORD = 8, 6
MOST_WORDS = 300_000
# Targets: a margin's share of tokens, raised to the power and normalised.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.5}
TOKEN_SHARE = 0.5         # expected share of all tokens that is drawn
TOLERANCE, MOST_ROUNDS = 1e-3, 20
SEED = 11


def with_topics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__topic`` and ``__tokens`` (words); -1 and 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in slices(batches, text):
            topics, tokens = [], []
            for t in byte_list(b.column(text)):
                words = t.lower().split()
                long = {w for w in words if len(w) >= LONG_WORD}
                if len(known) + len(long) > MOST_WORDS:
                    known.clear()
                known.update((w, xxhash.xxh3_64_intdigest(w) % TOPICS) for w in long.difference(known))
                per = np.bincount([known[w] for w in long], minlength=TOPICS) if long else [0]
                topics.append(int(np.argmax(per)) if words else -1)
                tokens.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(topics, pa.int32()), pa.array(tokens, pa.int64())],
                [*b.schema.names, "__topic", "__tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, __topic int, __tokens long")


def _cell_columns(docs: DataFrame) -> DataFrame:
    """Adds the cell keys; a null source or language is a value of its own."""
    return docs.withColumns({
        "__source": F.coalesce(F.col("source").cast("string"), F.lit("(null)")),
        "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("(null)"))})


def rake(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """Weights of ``cells`` (the dimensions and mass) that meet every target.

    ``targets``: per dimension a table (dimension, target), shares that sum to
    1.  Rounds go on until every margin is within ``TOLERANCE`` of its target;
    after ``MOST_ROUNDS`` the last weights stand (targets that empty cells put
    out of reach).
    """
    dims = list(targets)
    cur = materialize(cells.withColumn("weight", F.col("mass").cast("double")), "rake")
    for _ in range(MOST_ROUNDS):
        step = cur
        for d in dims:
            scale = step.groupBy(d).agg(F.sum("weight").alias("__sum")).join(targets[d], d).select(
                d, (F.col("target") / F.col("__sum")).alias("__scale"))
            step = step.join(scale, d).withColumn("weight", F.col("weight") * F.col("__scale")).drop("__scale")
        nxt = materialize(step.select(*dims, "mass", "weight"), "rake")
        remove_table(cur)
        cur = nxt
        # the last dimension is met exactly; the others tell how far it is
        off = [cur.groupBy(d).agg(F.sum("weight").alias("w")).join(targets[d], d).select(
            F.abs(F.col("w") / F.col("target") - 1).alias("off")) for d in dims[:-1]]
        worst = off[0]
        for o in off[1:]:
            worst = worst.unionByName(o)
        if (worst.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return cur


def power_targets(cells: DataFrame, powers: Mapping[str, float]) -> dict[str, DataFrame]:
    """Margins' token shares raised to a power and normalised."""
    out = {}
    for d, power in powers.items():
        raised = cells.groupBy(d).agg(F.pow(F.sum("mass").cast("double"), F.lit(power)).alias("r"))
        total = raised.agg(F.sum("r")).first()[0] or 1.0
        out[d] = materialize(raised.select(d, (F.col("r") / total).alias("target")), "targets")
    return out


def probabilities(raked: DataFrame, token_share: float) -> DataFrame:
    """Adds ``probability``, capped at 1, with the expected tokens at the budget."""
    cells = raked.withColumn("rate", F.col("weight") / F.col("mass"))
    budget = token_share * (cells.agg(F.sum("mass")).first()[0] or 0)
    k, full = 0.0, -1
    while True:  # cells at probability 1 only grow in number, so this ends
        row = cells.agg(F.sum(F.when(k * F.col("rate") >= 1, F.col("mass"))).alias("capped"),
                        F.sum(F.when(k * F.col("rate") >= 1, 0.0).otherwise(F.col("weight"))).alias("open"),
                        F.count(F.when(k * F.col("rate") >= 1, 1)).alias("full")).first()
        if row.full == full or not row.open:
            return cells.withColumn("probability", F.least(F.lit(1.0), k * F.col("rate"))).drop("rate")
        k, full = max(k, (budget - (row.capped or 0)) / row.open), row.full


def mix(docs: DataFrame, powers: Mapping[str, float] = POWERS, token_share: float = TOKEN_SHARE,
        seed: int = SEED) -> DataFrame:
    """``docs`` with ``__probability`` and ``__drawn`` (and the cell columns).

    Documents without words belong to no cell: probability 1, always drawn.
    Equal rows share their draw; an empty table stays empty.
    """
    rows = _cell_columns(with_topics(docs))
    cells = materialize(rows.where("__tokens > 0").groupBy(
        F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(
        F.sum("__tokens").alias("mass")), "cells")
    drawn = probabilities(rake(cells, power_targets(cells, powers)), token_share).select(
        F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"),
        F.col("probability").alias("__probability"))
    joined = rows.join(drawn, ["__source", "__lang", "__topic"], "left")
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) * F.lit(2.0 ** -53)
    return joined.withColumn("__probability", F.coalesce("__probability", F.lit(1.0))).withColumn(
        "__drawn", uniform < F.col("__probability"))
