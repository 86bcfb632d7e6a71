"""Request counts per day, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_requests(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """`day, requests, users` from rows `ts, user_id`. Requests without a user are no user.

    Counting per user first makes the distinct count a plain sum of rows, spreads a busy day over
    many tasks, and works on streams, where distinct aggregates are not available.
    """
    if requests.isStreaming:
        requests = requests.withWatermark("ts", lateness)
    per_user = requests.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"))
    day = F.window(F.window_time("window"), "1 day")
    return per_user.groupBy(day.alias("window")).agg(F.sum("n").alias("requests"), F.count("user_id").alias("users")).select(
        F.col("window.start").alias("day"), "requests", "users"
    )
