"""The registered queries of this subpackage, with SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.llm import (
    bpe, bytebpe, fim, hyperplanes, mixing, periods, pii, quality, quotes, secrets, setsketch, suffixtree, wavelet)
from dealflow.llm.common import table
from dealflow.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = bpe.encode(table(spark, sf_dir, "documents"), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    out = bpe.decode(ids, path, keep=("doc_id", "n_tokens", "ids_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


# Stands for a secret that a user keeps; one key names one set of surrogates.
PII_KEY = b"registered query key"


@query
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


@query
def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(
        table(spark, sf_dir, "documents"), shared_path(spark, "wavelet"), tokenizer_path())
    return wavelet.read_documents(shards)


@query
def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_hyperplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplanes.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op5_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.scan(docs, shared_path(spark, "ledger")))


def _secrets_sql() -> str:
    """The rules once more: gaps and matches per kind, places by running sums."""
    kinds = []
    for rank, r in enumerate(secrets.RULES):
        quoted = r.pattern.replace("'", "''")
        parts = ", ".join(f"regexp_extract_all(t, '(?s)(.*?)({quoted})', {k}) AS p{k}" for k in (1, 2, 3))
        kinds.append(f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, {parts} "
                     f"FROM d WHERE regexp_matches(t, '{quoted}')")
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    spans = "string_agg(kind || ':' || (stop - length(m)) || ':' || stop, ',' ORDER BY stop - length(m), rank)"
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(kinds)}),
rows AS (SELECT doc_id, kind, rank, least, generate_subscripts(p2, 1) AS k,
                unnest(p1) AS gap, unnest(p2) AS m, unnest(p3) AS secret FROM found),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k)::BIGINT AS stop FROM rows),
good AS (SELECT * FROM placed WHERE length(secret) >= least),
per_doc AS (SELECT doc_id, {sums}, string_agg(kind || ':' || (stop - length(m)) || ':' || stop, ','
                   ORDER BY stop - length(m), rank) FILTER (kind IN ({base})) AS base,
                   {spans} AS spans FROM good GROUP BY doc_id)
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (doc_id)"""


ORACLE["op5_blob_ledger"] = _secrets_sql()


@query
def op8_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.fit_and_assess(docs, table(spark, sf_dir, "labels"))


@query
def op6_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"),
                        F.col("__probability").alias("probability"), F.col("__drawn").alias("drawn"))


@query
def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"))


@query
def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(table(spark, sf_dir, "conversations"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


# Cuts by the four draws over code points; hex digits are read as numbers.
ORACLE["op11_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT *, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS u, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS v,
         CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
p AS (
  SELECT *, least(u, v) AS a, greatest(u, v) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
m AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM m"""


@query
def op12_synchronising_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plant = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periods.report(periods.find_runs(docs, plant=plant))


@query
def op13_byte_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ids = bytebpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    out = bytebpe.decode(ids, path, keep=("doc_id", "n_tokens"))
    return out.select("doc_id", "n_tokens", F.sha2("id_text", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


# Both reach a document's or vector's component by passing least ids along links.
_COMPONENTS = """
sides AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(id, least_id) AS (
  SELECT DISTINCT x, x FROM sides
  UNION SELECT sides.y, reach.least_id FROM reach JOIN sides ON sides.x = reach.id WHERE reach.least_id < sides.y),
comp AS (SELECT id, min(least_id) AS component_id FROM reach GROUP BY id)"""

ORACLE["op4_setsketch"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
                            FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL)
          JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
{_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = doc_id"""

ORACLE["op7_hyperplanes"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
          ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
{_COMPONENTS},
many AS (SELECT x AS id, count(*) AS n FROM sides GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN many ON many.id = vec_id LEFT JOIN comp ON comp.id = vec_id"""
