"""The pipeline's stages against plain versions."""

import brute
import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F


def test_whole(spark, sf):
    """Every stage is held against the plain version on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    first = pipeline.language(spark, docs, sf).cache()
    assert first.columns == docs.columns
    assert len(texts(first)) > 0.95 * docs.count()
    given = texts(docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
    assert given and set(given) <= set(texts(first))
    second = pipeline.near_dedup(spark, first, sf).cache()
    groups = brute.groups(texts(first), 5)
    assert texts(second) == [(i, t) for i, t in texts(first) if groups[i] == i]
    assert second.columns == docs.columns
    third = pipeline.suffix_dedup(spark, second, sf).cache()
    removed = {i: r[1] for i, r in brute.repeats(texts(second)).items()}
    left = dict(texts(third))
    for i, text in texts(second):
        if not removed[i]:
            assert left[i] == text
        elif i in left:
            assert len(left[i].encode()) < len(text.encode())
        else:
            assert removed[i] > 0.9 * len(text.encode())
    assert third.where(F.char_length("text") != F.col("n_chars")).count() == 0
    pieces = [r.asDict() for r in pipeline.pack(spark, third, sf).collect()]
    brute.check_packed(pieces, brute.word_ids(texts(third)))
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in pieces) and len(pieces) == pipeline.run(spark, sf).count()


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, sf, empty):
    """Nulls in every column, repeated rows and extra columns with the operators' own names."""
    rows = [
        (1, "the cat sat on the mat and the dog sat on the rug", "en", "a", 49, 1, "x", [1], None),
        (1, "the cat sat on the mat and the dog sat on the rug", "en", "a", 49, 2, None, None, 0.5),
        (None, "der Hund und die Katze sind im Haus mit dem Kind", None, None, None, None, None, None, None),
        (2, None, None, None, None, None, "y", None, None),
        (3, "", "en", "b", 0, 1, "z", [], 1.5),
        (4, "... 123", "de", "b", 7, 1, "z", [2, 3], 1.5),
        (5, "der Hund und die Katze sind im Haus mit dem Kind " * 4, "de", "b", 7, 1, "z", [2, 3], 1.5),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, uid int, kept string, bands array<int>, score double"
    docs = spark.createDataFrame([] if empty else rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    left = docs.collect()
    if empty:
        assert not left and pipeline.pack(spark, docs, sf).count() == 0
    else:
        assert sum(r.doc_id == 1 for r in left) == 1 and not any(r.doc_id in (2, 3, 4) for r in left)
        assert pipeline.pack(spark, docs, sf).count() >= len(left)
