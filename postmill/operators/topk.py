"""The best hits of an all-words query without scoring every hit.

Posts are dealt into blocks by their length: a class holds neighbouring lengths with about BLOCK posts, and a class with more
is split by a hash of the id. A posting is stored by (bucket, term, block, id), and a small table has for every term and
block the highest weight that one of its postings can give. The sum of these over the words of a query is the
most that a post of the block can score. Blocks are opened by descending bound, a few at first and then more, until the
k-th score found is above the bound of all that are left; a filter on block numbers reaches the scan, which skips the
files, row groups and pages of the others. Short posts score higher, so bounds differ widely between blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.operators.search import B, K1, Index, POSTING_COLUMNS, query_words, ranked, term_bucket

BLOCK = 10_000  # posts of a block, about
FIRST, GROWTH = 8, 4  # blocks opened at first, and times more in each further round
_SLACK = 1e-9  # for sums of the same numbers in another order


def _weight(tf: Column, dl: Column, average: Column) -> Column:
    """What a posting adds to a score, before the rarity of its term."""
    return tf / (tf + F.lit(K1) * (1 - B + B * dl / average))


def write_blocks(index: Index, path: str, buckets: int = 64, block: int = BLOCK) -> None:
    """Stores an index in blocks: `postings`, `bounds` and `meta`."""
    spark = index.docs.sparkSession
    lengths = index.docs.groupBy("dl").agg(F.count("*").alias("n"))  # a row for each length there is
    before = F.sum("n").over(Window.orderBy("dl").rowsBetween(Window.unboundedPreceding, -1))
    classes = lengths.withColumn("at", F.floor(F.coalesce(before, F.lit(0)) / block)).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    # a length with several parts takes as many numbers, which the posts before it leave free
    classes.select("dl", "at", "parts").write.parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    placed = index.postings.join(classes, "dl").select(
        *POSTING_COLUMNS,
        (F.col("at") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"),
        term_bucket(F.col("term"), buckets).alias("bucket"),
    )
    placed = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block", "id")
    placed.write.partitionBy("bucket").parquet(f"{path}/postings")
    totals = index.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl")).withColumn("buckets", F.lit(buckets))
    totals.write.parquet(f"{path}/meta")
    average = spark.read.parquet(f"{path}/meta").agg(F.max("avg_dl")).scalar()
    weight = _weight(F.col("tf"), F.col("dl"), average)
    bounds = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term", "block").agg(F.max(weight).alias("most"), F.count("*").alias("n"))
    bounds.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/bounds")


@dataclass
class Page:
    rows: DataFrame  # rank, id, score, total
    opened: int  # blocks scored
    blocks: int  # blocks that have all words


class Blocks:
    """A stored index in blocks."""

    def __init__(self, spark: SparkSession, path: str):
        self.meta = spark.read.parquet(f"{path}/meta").first()
        self.postings, self.bounds = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "bounds"))

    def _of(self, table: DataFrame, words: list[str]) -> DataFrame:
        # the bucket numbers fold to literals and prune folders
        return table.where(F.col("bucket").isin(*[term_bucket(F.lit(w), self.meta["buckets"]) for w in words])).where(F.col("term").isin(*words))

    def _idf(self, words: list[str]) -> tuple[dict[str, float], int]:
        """Rarity of each word by the ranking's formula, and the posts with the rarest."""
        rows = self._of(self.bounds, words).groupBy("term").agg(F.sum("n").alias("df")).withColumn(
            "idf", F.log(1 + (F.lit(self.meta["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        )
        found = {r["term"]: r for r in rows.collect()}  # a row a word
        return {w: found[w]["idf"] for w in words if w in found}, min((r["df"] for r in found.values()), default=0)

    def _scored(self, words: list[str], idf: dict[str, float], blocks: list[int] | None) -> DataFrame:
        """`id, score` of the posts with all words, in the given blocks (None: all)."""
        hits = self._of(self.postings, words)
        if blocks is not None:
            hits = hits.where(F.col("block").isin(blocks))
        t = F.col("term")
        frequencies = [F.max(F.when(t == w, F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(words)]
        slots = hits.groupBy("id").agg(F.max("dl").alias("dl"), *frequencies)
        score, every = F.lit(0.0), F.lit(True)
        for i, w in enumerate(words):
            tf = F.col(f"tf{i}")
            score, every = score + F.lit(idf[w]) * _weight(tf, F.col("dl"), F.lit(self.meta["avg_dl"])), every & tf.isNotNull()
        return slots.where(every).select("id", score.alias("score"))

    def top(self, text: str, limit: int = 10, offset: int = 0) -> Page:
        """The page of best posts with all words of a text, ties by id, and the exact number of all.

        That number comes from the table of bounds for one word; for several it counts their postings by post, without
        lengths and frequencies. A text without words, or with one that no post has, finds nothing.
        """
        words = list(dict.fromkeys(query_words(text)))
        idf, _ = self._idf(words) if words else ({}, 0)
        spark = self.postings.sparkSession
        if not words or len(idf) < len(words):
            return Page(spark.createDataFrame([], "rank bigint, id bigint, score double, total bigint"), 0, 0)
        weight = F.coalesce(*[F.when(F.col("term") == w, F.lit(v)) for w, v in idf.items()])
        bounds = self._of(self.bounds, words).groupBy("block").agg(F.sum(weight * F.col("most")).alias("bound"), F.count("*").alias("words"), F.max("n").alias("n"))
        bounds = bounds.where(F.col("words") == len(words))
        blocks, opened = bounds.count(), FIRST
        while True:
            best = bounds.orderBy(F.desc("bound"), "block").limit(opened + 1).collect()
            found = self._scored(words, idf, None if opened >= blocks else [r["block"] for r in best[:opened]])
            if opened >= blocks:
                break
            kth = [r["score"] for r in found.orderBy(F.desc("score"), "id").limit(limit + offset).collect()]
            if len(kth) == limit + offset and kth[-1] > best[opened]["bound"] + _SLACK:
                break
            opened *= GROWTH
        if len(words) == 1:
            total = self._of(self.bounds, words).agg(F.sum("n")).scalar()
        else:
            total = self._of(self.postings, words).groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") == len(words)).agg(F.count("*")).scalar()
        return Page(ranked(found, limit, offset).withColumn("total", total), min(opened, blocks), blocks)
