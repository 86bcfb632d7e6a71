"""Block bounds against scoring every hit."""

import random

from pyspark.sql import functions as F

from postmill.operators import search as S
from postmill.operators import topk as TK
from postmill.plans import fixtures as fx


def test_blocks_are_skipped_and_nothing_is_lost(spark, sf, tmp_path):
    docs = fx.fx_posts(spark, sf).select("id", "created", "body")
    rng = random.Random(3)
    more = [(10_000 + i, " ".join(rng.choice(("la", "que", "und", "x", "y")) for _ in range(rng.randint(1, 300)))) for i in range(800)]
    docs = docs.unionByName(spark.createDataFrame(more, "id long, body string").withColumn("created", F.timestamp_seconds(F.lit(0))))
    index = S.build_index_once(docs)
    TK.write_blocks(index, str(tmp_path / "b"), buckets=4, block=20)
    blocks = TK.Blocks(spark, str(tmp_path / "b"))
    skipped = 0
    for text, limit, offset in (("la que", 10, 0), ("und", 5, 7), ("la que und x", 3, 0), ("y", 2000, 0), ("Que LA que", 10, 20)):
        page = blocks.top(text, limit, offset)
        want = S.search(index, must=S.words_clause(text), limit=limit, offset=offset)
        assert [(r["rank"], r["id"], round(r["score"], 9), r["total"]) for r in page.rows.orderBy("rank").collect()] == [
            (r["rank"], r["id"], round(r["score"], 9), r["total"]) for r in want.orderBy("rank").collect()
        ]
        skipped += page.opened < page.blocks
    assert skipped >= 3
    assert blocks.top("").rows.count() == 0 and blocks.top("la nowhere").rows.count() == 0


def test_the_filter_reaches_the_scan(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(100)], "id long, body string").withColumn("created", F.timestamp_seconds(F.lit(0)))
    TK.write_blocks(S.build_index_once(docs), str(tmp_path / "b"), buckets=2, block=2)
    page = TK.Blocks(spark, str(tmp_path / "b")).top("word", 3)
    page.rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "In(block" in plan and page.opened < page.blocks
    assert [r["total"] for r in page.rows.collect()] == [100] * 3
