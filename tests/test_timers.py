"""Waits and deliveries that end by the clock of the stream."""

import pytest
from pyspark.sql import functions as F

from postmill.operators import outbox as OB
from postmill.plans import fixtures as fx
from postmill.streaming import timers as TM


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def run(spark, batches, schema, make, tmp_path, name):
    """What a stream gives of batches of rows, one file and micro-batch each; the sets that each batch adds."""
    path, out, told = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out"), []
    spark.createDataFrame([], schema).write.parquet(path)
    stream = make(spark.readStream.schema(schema).parquet(path))
    seen = set()
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis(F.unix_millis("ts"))).coalesce(1).write.mode("append").parquet(path)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        now = {tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()}
        told.append(now - seen)
        seen = now
    return told


def test_polls_that_stop_time_out(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    ms = lambda s: int(at(s).timestamp() * 1000)
    row = lambda m, seq, s, code: (m, seq, at(s), code)
    batches = [
        [row("stops", 2, 8, 206), row("stops", 1, 5, 206), row("done", 1, 5, 206), row("fails", 1, 6, 500), row("late", 2, 9, 206)],
        [row("done", 2, 20, 200), row("late", 1, 3, 206), row("edge", 1, 0, 206), row("edge", 2, 30.5, 200), row("slow", 1, 0, 206), row("slow", 2, 30, 206)],
        [row("clock", 1, 2000, 206)],  # moves the watermark past every wait, with no poll of theirs
        [row("clock", 2, 2001, 206), row("stops", 9, 2001, 200)],
    ]
    told = run(spark, batches, "media_id string, seq int, ts timestamp, code int", TM.poll_outcomes, tmp_path, "polls")
    want = {("stops", "timed_out", ms(36)), ("done", "done", ms(20)), ("fails", "failed", ms(6)), ("late", "timed_out", ms(34)), ("edge", "done", ms(30.5)), ("slow", "timed_out", ms(30))}
    assert told[0] | told[1] == set() and told[2] | told[3] == want  # a poll after the end changes nothing


def test_deliveries_close_when_idle(spark, sf, tmp_path):
    attempts = fx.fx_attempts(spark, sf).where("post_id < 40")
    rows = attempts.select("post_id", F.col("step").cast("bigint").alias("step"), "seq", F.timestamp_seconds("seq").alias("ts"), "ok")
    data = [tuple(r) for r in rows.orderBy("seq").collect()]
    far = [(-1, 1, 0, data[-1][3].replace(year=2090 + k), True) for k in range(2)]
    batches = [data[::2], data[1::2], far[:1], far[1:]]  # interleaved: the second batch is older in part
    make = lambda s: TM.delivery_outcomes(s, idle_ms=86_400_000, lateness="10 days")
    told = run(spark, batches, rows.schema, make, tmp_path, "deliveries")
    want = {(r["post_id"], r["step"], r["status"], r["attempts"]) for r in OB.delivery_status(attempts).collect()}
    assert told[0] | told[1] == set() and {r for r in told[2] | told[3] if r[0] >= 0} == want
    assert {"blocked", "done"} <= {r[2] for r in want}
