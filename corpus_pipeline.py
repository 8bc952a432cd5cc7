"""Corpus pipeline: filter, deduplicate, clean, mix and encode ``documents``.

Each stage takes what its predecessor kept (written and read again) and its
decisions take effect: rejected and duplicate documents go, secrets are blanked,
documents outside the mix go, and the rest is encoded.  All stages but the last
return the columns of ``documents``; a null doc_id, null or empty texts,
repeated rows and extra columns pass as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.llm import bpe, mixing, quality, secrets, setsketch
from dealflow.llm.common import table
from dealflow.llm.queries import tokenizer_path
from dealflow.session import shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; rows that repeat its id stay with it."""
    found = setsketch.near_duplicates(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets blanked and their n_chars brought up to date."""
    found = secrets.scan(docs, shared_path(spark, "ledger"))
    return secrets.redact(docs, found, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mix of sources, languages and topics."""
    return mixing.mix(docs).where("__drawn").select(*(f"`{c}`" for c in docs.columns))


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every document: doc_id, n_tokens, ids (little-endian uint32)."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("secret scan", secret_scan),
          ("mixing", mix_sources), ("bpe", encode_ids)]

# Learned scores, sketches and raking have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
