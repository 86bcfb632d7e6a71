"""Keyed state over streams in event-time order.

Rows of a key are buffered until the watermark has passed them, then folded in order. A subclass of
rules only says how one row changes the state and what it emits. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators import tokens
from postmill.operators.publish import edit_step
from postmill.streaming.slots import SlotProcessor, folded, key_of, key_text, slot, slotted

Step = Callable[[dict, dict, tuple], list[tuple]]


class OrderedFold(SlotProcessor):
    """Folds the rows of each key by `(ts_ms, seq)`.

    `step(state, row, key)` changes the state dictionary in place and returns output tuples.
    """

    def __init__(self, output: list[str], step: Step):
        self.columns, self.step = output, step

    def key_due(self, key, state, due, rest, passed):
        state, out, own = state or {}, [], (key_of(key),)
        for ts_ms, seq, text in due:
            out += self.step(state, {"ts_ms": ts_ms, "seq": seq, **json.loads(text)}, own)
        return out, state, rest, None


def _fold(
    stream: DataFrame, key: str, schema: str, fields: list[str], step: Step, lateness: str, start: DataFrame | None = None
) -> DataFrame:
    output = [c.split()[0] for c in schema.split(", ")]
    rows = slotted(stream.withWatermark("ts", lateness), key, fields)
    return folded(rows, OrderedFold(output, step), schema, None if start is None else start.select(slot(key), key_text(key), "state"))


def _token_step(state: dict, row: dict, key: tuple) -> list[tuple]:
    ts_s = row["ts_ms"] // 1000
    state["created"], outcome = tokens.step(state.get("created"), ts_s, row["kind"])
    return [(row["seq"], key[0], ts_s, row["kind"], outcome)]


def token_stream(log: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Outcomes of a stream `seq, handle, ts, kind`; the same rule as the batch form."""
    return _fold(log, "handle", "seq bigint, handle string, ts_s bigint, kind string, outcome string", ["kind"], _token_step, lateness)


def _edit_stream_step(year: int) -> Step:
    def step(state: dict, row: dict, key: tuple) -> list[tuple]:
        for role in ("media", "full"):
            if state.get(role):
                url, version = state[role]
                state[role] = (url, version if version is None else int(version))
        if row["deleted"]:
            state["deleted"] = True
            return [(key[0], row["seq"], "delete", None, None, None)]
        done = edit_step(state, int(key[0]), year, row["media_url"], row["full_url"])
        media, full = state.get("media"), state.get("full")
        return [(key[0], row["seq"], done[0], media and media[0], media and media[1], full and full[0])]

    return step


def stored_media(posts: DataFrame) -> DataFrame:
    """The state that edits of stored posts start from: `post_id, state`."""
    role = lambda m: F.when(F.col(m).isNotNull(), F.array(F.col(f"{m}.url"), F.col(f"{m}.version").cast("string")))
    pairs = F.struct(role("media").alias("media"), role("media_full").alias("full"))
    return posts.select(F.col("id").alias("post_id"), F.to_json(pairs).alias("state"))


def edit_stream(edits: DataFrame, year: int, lateness: str = "10 minutes", start: DataFrame | None = None) -> DataFrame:
    """Edits of each post in strict order: media action, current media url and version.

    Input `post_id, seq, ts, media_url, full_url, deleted`; the state of a post is its last media,
    version and deletion. `start` (see `stored_media`) is what posts have before the stream begins.
    """
    schema = "post_id bigint, seq bigint, action string, media_url string, media_version bigint, full_url string"
    return _fold(edits, "post_id", schema, ["media_url", "full_url", "deleted"], _edit_stream_step(year), lateness, start)


def _poll_step(wait_ms: int) -> Step:
    def step(state: dict, row: dict, key: tuple) -> list[tuple]:
        if state.get("ended"):
            return []
        start = state.setdefault("start", row["ts_ms"])
        code = int(row["code"])
        if code == 206 and row["ts_ms"] - start < wait_ms:
            return []
        state["ended"] = True
        outcome = "done" if code == 200 else "timed_out" if code == 206 else "failed"
        return [(key[0], outcome, row["ts_ms"])]

    return step


def poll_stream(polls: DataFrame, wait_ms: int = 30_000, lateness: str = "10 minutes") -> DataFrame:
    """Outcome per `media_id` of a stream of polls `media_id, seq, ts, code`."""
    return _fold(polls, "media_id", "media_id string, outcome string, ended_ms bigint", ["code"], _poll_step(wait_ms), lateness)


def _delivery_step(retries: int) -> Step:
    def step(state: dict, row: dict, key: tuple) -> list[tuple]:
        mine = state.setdefault(str(row["step"]), {"tries": 0, "fails": 0, "done": False})
        if mine["done"] or mine["fails"] >= retries:
            return []
        mine["tries"] += 1
        mine["done"] = bool(row["ok"])
        mine["fails"] += 0 if row["ok"] else 1
        status = "done" if mine["done"] else "gave_up" if mine["fails"] >= retries else "retry"
        return [(key[0], int(row["step"]), row["seq"], status, mine["tries"])]

    return step


def delivery_stream(attempts: DataFrame, retries: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """Status of a step after each attempt that counts, from a stream `post_id, step, seq, ts, ok`."""
    schema = "post_id bigint, step bigint, seq bigint, status string, attempts bigint"
    return _fold(attempts, "post_id", schema, ["step", "ok"], _delivery_step(retries), lateness)
