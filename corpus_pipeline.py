"""A training-data pipeline over `documents`: each stage works on all that its predecessor kept.

All stages but the last return the columns of their input. Columns other than those of `documents` pass through,
whatever they are called. Rows with equal doc_id are separate documents, as are those without one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from postmill.llm import langid, minhash, packing, suffix
from postmill.session import new_path

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5  # mean probability of the language below which a text without a given one is rejected


def _plain(docs):
    """`docs` with columns beyond DOCUMENT renamed, so that they clash with nothing."""
    seen: set[str] = set()
    names = []
    for i, name in enumerate(docs.columns):
        own = name in DOCUMENT and name not in seen
        seen.add(name)
        names.append(name if own else f"extra_{i}")
    return docs.toDF(*names)


def language(spark, docs, sf_dir):
    """Keeps documents whose language is given or known with some certainty, and fills in a missing lang.

    Null and empty texts, and texts without a letter, go, whatever their lang. Learns as the language query does; if no row is
    labelled, only those texts go.
    """
    plain = _plain(docs)
    network = langid.learn(plain, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    if network is None:
        return plain.where(F.col("text").rlike(r"\p{L}")).toDF(*docs.columns)
    found = langid.predict(plain, network, plain.columns)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang").isNotNull() | (F.col("score") >= LEAST_SCORE)))
    kept = kept.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(*plain.columns).toDF(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """Keeps the first document of each group linked by five-word shingles at a similarity of 0.8."""
    plain = _plain(docs)
    found = minhash.near_duplicates(plain, words=5, threshold=80, columns=tuple(plain.columns))
    return found.where("kept").select(*plain.columns).toDF(*docs.columns)


def suffix_dedup(spark, docs, sf_dir):
    """Cuts out passages of 100 bytes or more that an earlier document has; documents with nothing left go.

    n_chars becomes the length of what is left.
    """
    plain = _plain(docs)
    rest = [c for c in plain.columns if c not in ("text", "n_chars")]
    found = suffix.remove_repeats(plain, 100, keep_text=True, columns=tuple(rest))
    found = found.where((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    text = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return found.select(*(text[c].alias(c) if c in text else F.col(c) for c in plain.columns)).toDF(*docs.columns)


def pack(spark, docs, sf_dir):
    """Packs the token ids of what is left into sequences of 2048."""
    return packing.pack(_plain(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]
# A trained network, circulant signatures and greedy packing cannot be said in SQL: tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
