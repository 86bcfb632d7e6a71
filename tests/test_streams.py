"""Streams against their batch forms: input split over several files, replays change nothing."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postmill.operators import facts as FX
from postmill.operators import listing as L
from postmill.operators import outbox as OB
from postmill.operators import publish as PB
from postmill.operators import search as S
from postmill.operators.tokens import token_outcomes
from postmill.plans import fixtures as fx
from postmill.sources.store import Store
from postmill.streaming import apply as AP
from postmill.streaming import ordered as OR
from postmill.streaming.requests import daily_requests

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def drain(stream, tmp_path, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return {tuple(r) for r in stream.sparkSession.table(name).collect()}


def as_stream(rows, order, tmp_path, name, files=3):
    """Rows as a stream of `files` ordered files, one per micro-batch, closed by a far future row."""
    spark, path = rows.sparkSession, str(tmp_path / name)
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    span = (hi - lo) / files + 1
    for i in range(files):
        part = rows.where((F.col(order) >= lo + i * span) & (F.col(order) < lo + (i + 1) * span))
        part.coalesce(1).write.mode("append").parquet(path)
    for years in (40, 41):  # one batch to move the watermark, one to let it act
        end = rows.limit(1).withColumn("ts", F.col("ts") + F.make_interval(years=F.lit(years)))
        key = [c for c in ("handle", "media_id") if c in rows.columns]
        end = end.withColumn(key[0], F.lit("end")) if key else end.withColumn("post_id", F.lit(-1).cast("bigint"))
        end.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_tokens(spark, sf, tmp_path):
    log = fx.fx_tokens(spark, sf)
    rows = log.select("seq", "handle", F.timestamp_seconds("ts_s").alias("ts"), "kind").withColumn("at", F.unix_seconds("ts"))
    got = drain(OR.token_stream(as_stream(rows, "at", tmp_path, "tokens").drop("at")), tmp_path, "token_out")
    assert {r for r in got if r[1] != "end"} == {tuple(r) for r in token_outcomes(log).collect()}


@pytest.mark.parametrize("chunk_s", [60, 900, 86400])
def test_token_chunks_do_not_matter(spark, sf, chunk_s):
    busy = fx.fx_tokens(spark, sf).withColumn("handle", F.lit("one")).withColumn(
        "kind", F.when(F.col("seq") % 40 == 0, "redeem").otherwise("issue")
    )
    whole = {tuple(r) for r in token_outcomes(busy, chunk_s=10_000_000).collect()}
    assert {tuple(r) for r in token_outcomes(busy, chunk_s=chunk_s).collect()} == whole


def test_polls(spark, sf, tmp_path):
    polls = fx.fx_status(spark, sf).withColumn("ts", F.timestamp_millis("ts_ms")).select("media_id", "seq", "ts", F.col("code").cast("bigint").alias("code"), "ts_ms")
    got = drain(OR.poll_stream(as_stream(polls, "ts_ms", tmp_path, "polls").drop("ts_ms")), tmp_path, "poll_out")
    want = OB.poll_outcome(fx.fx_status(spark, sf)).where("outcome <> 'waiting'")
    assert {r for r in got if r[0] != "end"} == {tuple(r) for r in want.collect()}


def test_delivery(spark, sf, tmp_path):
    attempts = fx.fx_attempts(spark, sf)
    rows = attempts.select(F.col("post_id"), F.col("step").cast("bigint").alias("step"), "seq", F.timestamp_seconds("seq").alias("ts"), "ok")
    got = drain(OR.delivery_stream(as_stream(rows, "seq", tmp_path, "attempts")), tmp_path, "delivery_out")
    last = {}
    for post, step, seq, status, tries in sorted(got, key=lambda r: r[2]):
        last[post, step] = (status, tries)
    want = {(r["post_id"], r["step"]): (r["status"], r["attempts"]) for r in OB.delivery_status(attempts).collect()}
    for key, value in want.items():
        if value[0] != "blocked":
            assert last[key] == value


def test_edits_in_order(spark, sf, tmp_path):
    edits = fx.fx_edits(spark, sf).where("post_id < 60")
    rows = edits.select("post_id", "seq", F.timestamp_seconds(F.col("seq") * 1000).alias("ts"), "media_url", "full_url", F.lit(False).alias("deleted"))
    got = drain(OR.edit_stream(as_stream(rows, "seq", tmp_path, "edits"), 2024), tmp_path, "edit_out")
    posts = fx.posts(spark, sf).withColumn("media", F.lit(None).cast("struct<url:string,version:bigint>")).withColumn("media_full", F.col("media"))
    plan = PB.publish_plan(posts, edits.withColumn("author", F.lit(None).cast("string")), 2024)
    want = plan.select("post_id", "seq", "media_action", "media_url", "media_version", "full_url")
    assert {r for r in got if r[0] != -1} == {tuple(r) for r in want.collect()}


def test_requests(spark, sf, tmp_path):
    rows = fx.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    path = str(tmp_path / "requests")
    rows.repartition(3).write.parquet(path)
    far = spark.range(1).select(F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"), F.lit(0).cast("bigint").alias("user_id"))
    for _ in range(2):
        far.write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    got = drain(daily_requests(stream), tmp_path, "requests_out")
    assert got == {tuple(r) for r in daily_requests(rows).collect()}


def test_apply_edits_and_replay(spark, sf, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.facts().count() == 0
    posts = fx.fx_posts(spark, sf).where("id <= 40")
    media = fx.fx_media(spark, sf).where("post_id <= 40")
    crossposts = fx.fx_crossposts(spark, sf).where("post_id <= 40")
    store.append(FX.facts_from_tables(posts, media, crossposts, tx=1), 1)
    edits = fx.fx_edits(spark, sf).where("post_id <= 40").withColumn("author", F.lit(None).cast("string"))
    path = str(tmp_path / "edits")
    for k in (1, 2, 3):
        edits.where(F.col("seq") == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = AP.edit_writer(stream, store, 2, NOW, str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and store.version() == 4

    def state():
        rows = store.posts().select("id", "body", F.col("media.url").alias("m"), F.col("media.version").alias("v"), F.col("media_full.url").alias("f"))
        return {tuple(r) for r in rows.collect()}

    after = state()
    plan = PB.publish_plan(fx.posts(spark, sf).where("id <= 40"), edits, 2024)
    last = plan.groupBy("post_id").agg(F.max_by(F.struct("body", "media_url", "media_version", "full_url"), "seq").alias("l"))
    for r in last.select("post_id", "l.*").collect():
        assert tuple(r) in after
    AP.apply_edits(store, edits.where("seq = 3"), 4, NOW)  # the same batch again
    assert state() == after
    AP.apply_deletes(store, posts.where("id = 7").select("id"), 5, NOW)
    assert store.posts().where("deleted").where("id = 7").count() == 1
    assert store.write_snapshot() == 5
    assert store.posts().count() == 40
    first = store.derived("contributors", lambda p: L.contributors(p, [])).collect()
    again = store.derived("contributors", lambda p: 1 / 0).collect()
    assert sorted(first) == sorted(again)


def test_segmented_index(spark, sf, tmp_path):
    posts = fx.fx_posts(spark, sf).select("id", "created", "body")
    changed = posts.where("id % 7 = 0").withColumn("body", F.concat(F.lit("fresh "), "body")).withColumn("seq", F.lit(1))
    index = AP.SegmentedIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(posts, 0)
    path = str(tmp_path / "changes")
    changed.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(changed.schema).parquet(path)
    for _ in range(2):  # a replay under another checkpoint overwrites its own segment
        query = AP.index_writer(stream, index, 1, str(tmp_path / f"cp{_}")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    want = S.build_index(posts.where("id % 7 <> 0").unionByName(changed.drop("seq")))
    got = index.index()
    assert {tuple(r) for r in S.term_stats(got).collect()} == {tuple(r) for r in S.term_stats(want).collect()}
    assert S.matches(got, must=[S.term("fresh")]).count() == changed.count()
    assert got.docs.count() == posts.count()
