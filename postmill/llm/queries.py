"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import infill, langid, licenses, lmscore, maxscore, minhash, negatives, packing, spm, spotsigs, suffix, toxicity, wavelet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query
def op1_spotsigs(spark: SparkSession, sf: str) -> DataFrame:
    return spotsigs.edited(documents(spark, sf))


@query
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_circulant_minhash(spark: SparkSession, sf: str) -> DataFrame:
    groups = minhash.near_duplicates(documents(spark, sf), words=2, threshold=80)
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query
def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return spm.round_trip(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(documents(spark, sf))


@query
def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf))


@query
def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    network = langid.learn(docs, part != 2)
    found = langid.predict(docs.withColumn("held_out", F.coalesce(part == 2, F.lit(False))), network, ["doc_id", "held_out"])
    return found


@query
def op8_maxscore(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return maxscore.top_k(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op9_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    return lmscore.score(documents(spark, sf), good)


@query
def op10_wavelet(spark: SparkSession, sf: str) -> DataFrame:
    return wavelet.round_trip(spark, documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_infill(spark: SparkSession, sf: str) -> DataFrame:
    return infill.digests(documents(spark, sf))


@query
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.mine(vectors, label, F.col("vec_id") % 100 == 0)


@query
def op13_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    judge = toxicity.learn_all(docs, spark.read.parquet(f"{sf}/labels.parquet"), part != 2)
    return toxicity.score(docs.withColumn("held_out", F.coalesce(part == 2, F.lit(False))), judge, ["doc_id", "held_out"])


# Units are listed and joined again instead of matched by count.
ORACLE["op11_infill"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

# The component, score and rank arithmetic is exact in whole numbers, so SQL gives the same rows.
ORACLE["op8_maxscore"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5
), r AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS n
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE n <= 5
"""
