"""Operator 5: secret scans over an incremental ledger of blobs.

Every text of every snapshot is a blob named by its SHA-256.  The ledger holds
which (blob, rule, rule version) were scanned and what was found.  A scan
reads only the texts of blobs with a pair not yet in the ledger, one copy of
each, and joins the findings back to all rows that hold the blob.  A new rule
or version rescans all blobs for that rule alone.

Spans come from Spark's regular expressions: a match and the gap before it are
extracted together, anchored where the last match ended, and running sums of
their lengths give the places.  DataFrame functions only, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` has one group, the secret; shorter ones than ``least`` are dropped.

    Runs of one character class carry their least length in the pattern, which
    drops the same matches.  ``sieve`` occurs in every text with a match.
    """

    kind: str
    version: int
    pattern: str
    least: int
    sieve: str


# The base rules, then those this method adds (formats that no
# plain text has by chance).
BASE_RULES = [
    Rule("assign", 1, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
         r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6,
         r"""[DdTtNnYy]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""),
    Rule("access", 1, r"(AKIA[A-Z0-9]{16,})", 20, "AKIA"),
    Rule("hex", 1, r"([0-9a-f]{24,})", 24, "[0-9a-f]{24}"),
]
MORE_RULES = [
    Rule("github", 1, r"(gh[pousr]_[A-Za-z0-9]{36,})", 40, "gh[pousr]_"),
    Rule("jwt", 1, r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 40, "eyJ"),
    Rule("pem", 1, r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 27, "PRIVATE KEY-----"),
]
RULES = BASE_RULES + MORE_RULES

_SCANNED = "blob_id string, kind string, version int"
_FINDINGS = "blob_id string, kind string, version int, start long, stop long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger table; empty before the first scan."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap, all, secret>> of a rule's leftmost matches that do not overlap."""
    one = F.lit(rf"\G((?s:.*?))({rule.pattern})")
    parts = [F.regexp_extract_all(text, one, F.lit(k)) for k in (1, 2, 3)]
    return F.when(text.rlike(rule.sieve), F.arrays_zip(
        F.transform(parts[0], F.length).alias("gap"), F.transform(parts[1], F.length).alias("all"),
        F.transform(parts[2], F.length).alias("secret")))


def find(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings in blobs (blob_id, text, todo: kinds to scan)."""
    per_rule = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                         F.when(F.array_contains("todo", r.kind), _matches(F.col("text"), r)).alias("found"))
                for r in rules]
    rows = blobs.select("blob_id", F.explode(F.array(*per_rule)).alias("r")).where("r.found is not null").select(
        "blob_id", "r.kind", "r.version", "r.least", F.posexplode("r.found").alias("k", "m"))
    before = Window.partitionBy("blob_id", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("m.gap") + F.col("m.all")).over(before)
    return rows.withColumn("stop", stop).where("m.secret >= least").select(
        "blob_id", "kind", "version", (F.col("stop") - F.col("m.all")).cast("long").alias("start"),
        F.col("stop").cast("long").alias("stop"))


def address(docs: DataFrame, text: str = "text") -> Column:
    return F.sha2(F.coalesce(docs[text], F.lit("")), 256)


def scan(docs: DataFrame, ledger: str, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Bring the ledger up to date with ``docs``; returns the findings per blob.

    Findings are appended before the note that their blobs were scanned, so a
    broken run is repeated, and repeated findings count once.  Result: blob_id,
    spans (array of kind, start, stop by start, then kind as in ``rules``),
    only blobs with findings, current rule versions only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), address(docs, text).alias("blob_id"))
    current = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    wanted = rows.select("blob_id").distinct().select("blob_id", F.explode(current).alias("r")).select(
        "blob_id", "r.kind", "r.version")
    unseen = wanted.join(_read(spark, f"{ledger}/scanned", _SCANNED), ["blob_id", "kind", "version"], "left_anti")
    todo = unseen.groupBy("blob_id").agg(F.collect_set("kind").alias("todo"))
    # one row per blob, whatever ids its copies have: find() sums over a blob's matches
    texts = rows.groupBy("blob_id").agg(F.any_value("text").alias("text")).join(todo, "blob_id")
    find(texts.select("blob_id", "text", "todo"), rules).distinct().write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob_id", "kind", "version").write.mode("append").parquet(f"{ledger}/scanned")
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    versions = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
    found = _read(spark, f"{ledger}/findings", _FINDINGS).where(versions[F.col("kind")] == F.col("version")).distinct()
    span = F.struct("start", order[F.col("kind")].alias("rank"), "stop", "kind")
    return found.groupBy("blob_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def report(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Findings of every row (path): counts and digests of its blob's spans.

    Null and empty texts have none; repeated rows and null keys stay.
    """
    rows = docs.select(F.col(key).alias("doc_id"), address(docs, text).alias("blob_id"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"))

    def joined(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")

    def only(*kinds: str) -> Column:
        return F.filter("all", lambda s: s.kind.isin(*kinds))

    base = only(*(r.kind for r in BASE_RULES))
    counts = [F.size(only(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return rows.join(found, "blob_id", "left").withColumn("all", spans).select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``[secret]``; other texts as they are.

    ``length`` names a column that holds the text's code points, if there is one.
    """
    hits = found.select(F.col("blob_id").alias("__blob"), F.col("spans").alias("__spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), (acc.at + 1).cast("int"), (s.start - acc.at).cast("int"))
        fresh = s.start >= acc.at
        return F.struct(F.when(fresh, F.concat(acc.out, gap, F.lit("[secret]"))).otherwise(acc.out).alias("out"),
                        F.greatest(acc.at, s.stop).alias("at"))

    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(
        acc.out, F.substring(F.col(text), (acc.at + 1).cast("int"), F.length(F.col(text)))))
    rows = docs.withColumn("__blob", address(docs, text)).join(hits.hint("merge"), "__blob", "left")
    rows = rows.withColumn(text, F.when(F.col("__spans").isNotNull(), clean).otherwise(F.col(text)))
    if length in docs.columns:
        now = F.length(text).cast(docs.schema[length].dataType)
        rows = rows.withColumn(length, F.when(F.col("__spans").isNotNull(), now).otherwise(F.col(length)))
    return rows.select(*(f"`{c}`" for c in docs.columns))
