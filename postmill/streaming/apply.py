"""Applying a stream of edits to the store and to the search index, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators import facts as FX
from postmill.operators import publish as PB
from postmill.operators.search import Index, POSTING_COLUMNS, build_index_once, term_bucket
from postmill.session import dropping, durable
from postmill.sources.store import Store


def apply_edits(store: Store, edits: DataFrame, tx: int, now: datetime) -> None:
    """Publish one batch of edits as transaction `tx`.

    The batch is judged against the facts before `tx` and stored under `tx`, so applying it again
    after a failure gives the same store.
    """
    at = F.lit(now.astimezone(timezone.utc))
    with dropping(store.spark):
        facts = store.facts(before=tx)
        # ids, references and media of the posts that the batch touches are all it is judged by, so no stored body moves
        slim = facts.where(~F.col("a").isin(FX.BULKY))
        touched = durable(FX.facts_about(slim, edits.where("post_id is not null").select(F.col("post_id").alias("id"))))
        top = facts.agg(F.max("e").alias("e"), F.max(F.when(F.col("a") == "post/id", F.col("v_long"))).alias("id")).first()
        plan = PB.publish_plan(FX.snapshot(touched), edits, now.year, top_id=top["id"] or 0)
        store.append(PB.publish_facts(touched, plan, at, tx, top=top["e"] or 0), tx)


def apply_deletes(store: Store, post_ids: DataFrame, tx: int, now: datetime) -> None:
    facts = store.facts(before=tx)
    store.append(FX.soft_delete(facts, post_ids, F.lit(now.astimezone(timezone.utc)), tx), tx)


def edit_writer(edits: DataFrame, store: Store, first_tx: int, now: datetime | Callable[[int], datetime], checkpoint: str):
    """A stream writer that applies each micro-batch; start it with a trigger of choice.

    `now` may be a function of the transaction number, which must give the same time when a batch is applied again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        tx = first_tx + batch_id
        apply_edits(store, batch, tx, now(tx) if callable(now) else now)

    return edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


class SegmentedIndex:
    """A stored search index that grows by one segment per batch of changed posts.

    A segment's entries replace those of the same posts in earlier segments; nothing is rewritten.
    Adding a batch again overwrites its own segment only.
    """

    def __init__(self, spark, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def add(self, posts: DataFrame, batch: int) -> None:
        with dropping(self.spark):
            fresh = build_index_once(posts)
            postings = fresh.postings.withColumn("bucket", term_bucket(F.col("term"), self.buckets))
            (
                postings.hint("rebalance", "bucket")
                .sortWithinPartitions("bucket", "term", "id")
                .write.mode("overwrite")
                .partitionBy("bucket")
                .parquet(f"{self.path}/postings/batch={batch}")
            )
            fresh.docs.write.mode("overwrite").parquet(f"{self.path}/docs/batch={batch}")

    def index(self) -> Index:
        """The current index. Only posts of later segments are looked up to drop what they replaced."""
        docs = self.spark.read.option("basePath", f"{self.path}/docs").parquet(f"{self.path}/docs")
        postings = self.spark.read.option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings")
        first = docs.agg(F.min("batch").alias("b")).scalar()
        newest = docs.where(F.col("batch") > first).groupBy("id").agg(F.max("batch").alias("newest"))

        def live(df: DataFrame) -> DataFrame:
            joined = df.join(newest, "id", "left")
            return joined.where(F.col("newest").isNull() | (F.col("batch") == F.col("newest"))).drop("newest", "batch")

        return Index(live(docs), live(postings).select(*POSTING_COLUMNS, "bucket"), self.buckets)


def index_writer(posts: DataFrame, index: SegmentedIndex, first_batch: int, checkpoint: str):
    """A stream writer that indexes each micro-batch of changed posts (the last row of a post counts)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        columns = [c for c in batch.columns if c not in ("id", "seq")]
        latest = batch.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("p")).select("id", "p.*")
        index.add(latest, first_batch + batch_id)

    return posts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
