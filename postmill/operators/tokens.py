"""Log-in tokens: issued only when none is valid, valid for a time, consumed by use.

Whether a token is issued depends on the outcome of everything before it, so the log of a handle is
a chain. To split one busy handle over many tasks, its log is cut into chunks of time, each chunk
is summarised as a function of the token it starts with, the functions are chained (a few numbers
per chunk), and every chunk is then replayed with its true start.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.walk import Walker, sorted_walk

# fixed value: seconds a token stays valid, the limit included
TTL_S = 15 * 60
CHUNK_S = 3600


def step(created: int | None, ts: int, kind: str, ttl: int = TTL_S) -> tuple[int | None, str]:
    """One log row: the token's creation time before and after, and what came of the row."""
    valid = created is not None and ts - created <= ttl
    if kind == "issue":
        return (created, "still_valid") if valid else (ts, "issued")
    return (None, "ok") if valid else (created, "refused")


class _Summary(Walker):
    """The token left by a chunk, for each token it may start with.

    A redeem, or a pause longer than the limit, leaves the same state whatever came before, so the
    result is one number. Otherwise the start decides which issue is the first to succeed; the
    possible ones lie within the limit after the first row.
    """

    def __init__(self, key: tuple):
        self.key, self.created, self.chained, self.times = key, None, True, []

    def row(self, values: tuple) -> list[tuple]:
        _, _, ts, _, kind = values
        self.created, _ = step(self.created, ts, kind)
        if kind == "redeem" or (self.times and ts - self.times[-1] > TTL_S):
            self.chained = False
        if not self.times or (self.chained and ts != self.times[-1]):
            self.times.append(ts)  # distinct seconds, so at most the length of a chunk
        elif not self.chained:
            self.times[1:] = [ts]
        return []

    def end(self) -> list[tuple]:
        at, out, t = [], [], self.times
        if self.chained:
            after = [bisect_right(t, x + TTL_S) for x in t]  # the next issue to succeed after each
            final = list(t)
            for i in range(len(t) - 1, -1, -1):
                if after[i] < len(t):
                    final[i] = final[after[i]]
            last = min(after[0], len(t) - 1)
            at, out = t[1 : last + 1], final[1 : last + 1]
        return [(*self.key, t[0], self.created, self.chained, at, out)]


class _Chain(Walker):
    """Chains the chunk summaries of a handle: the token each chunk starts with."""

    def __init__(self, key: tuple):
        self.created = None

    def row(self, values: tuple) -> list[tuple]:
        handle, chunk, first_s, end_s, chained, at, out = values
        start = self.created
        if not chained or start is None or first_s - start > TTL_S:
            self.created = end_s
        else:
            i = bisect_right(at, start + TTL_S)
            if i < len(at):
                self.created = out[i]
        return [(handle, chunk, start)]


class _Replay(Walker):
    """The rows of a chunk, after a first row that only says what the chunk starts with."""

    def __init__(self, key: tuple):
        self.created = None

    def row(self, values: tuple) -> list[tuple]:
        handle, _, ts, seq, kind, start = values
        if seq is None:
            self.created = start
            return []
        self.created, outcome = step(self.created, ts, kind)
        return [(seq, handle, ts, kind, outcome)]


def token_outcomes(log: DataFrame, chunk_s: int = CHUNK_S) -> DataFrame:
    """`seq, handle, ts_s, kind, outcome` of a log of `issue` and `redeem` rows.

    A task replays one handle's chunk at a time; shorten `chunk_s` for very dense logs. The result
    does not depend on it.
    """
    chunk = F.floor(F.col("ts_s") / chunk_s).alias("chunk")
    rows = log.select("handle", chunk, "ts_s", "seq", "kind")
    keys = ["handle", "chunk"]
    summary = sorted_walk(
        rows, keys, ["ts_s", "seq"], _Summary,
        "handle string, chunk bigint, first_s bigint, end_s bigint, chained boolean, at array<bigint>, out array<bigint>",
    )
    carry = sorted_walk(summary, ["handle"], ["chunk"], _Chain, "handle string, chunk bigint, start_s bigint")
    none = F.lit(None)
    heads = carry.select("handle", "chunk", none.cast("bigint").alias("ts_s"), none.cast("bigint").alias("seq"), none.cast("string").alias("kind"), "start_s")
    # the start rides along as the chunk's first row: no join, so nothing can split a chunk
    both = rows.withColumn("start_s", none.cast("bigint")).unionByName(heads)
    return sorted_walk(both, keys, ["ts_s", "seq"], _Replay, "seq bigint, handle string, ts_s bigint, kind string, outcome string")
