"""Keyed state that acts by the clock of the stream: waits that end, and state that is dropped when it is over.

Rows wait until the watermark has passed them, so those of a key are judged in order of event time whatever the
order of arrival. Timers act when the watermark passes them, even if no further row of the key comes.
Needs the RocksDB state store.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from postmill.streaming.slots import SlotProcessor, folded, key_of, slotted

PENDING = 206
DONE = 200


class PollWait(SlotProcessor):
    """One medium's wait. It is `start` (the first poll), then an outcome, then nothing for `keep_ms`, and then forgotten."""

    columns = ["media_id", "outcome", "ended_ms"]
    acts_by_clock = filters = True

    def __init__(self, wait_ms: int, interval_ms: int, keep_ms: int):
        self.wait_ms, self.last_ms, self.keep_ms = wait_ms, wait_ms + interval_ms, keep_ms

    def wants(self, states, key):
        return "until" not in states.get(key, {})

    def key_due(self, key, state, due, rest, passed):
        if state and "until" in state:
            return ([], state, [], state["until"]) if passed < state["until"] else ([], None, [], None)
        if not state and not due:
            return [], None, rest, None
        start = state["start"] if state else due[0][0]  # no earlier poll can come any more
        codes = [(t, int(json.loads(r)["code"])) for t, _, r in due]
        ending = next(((t, c) for t, c in codes if t <= start + self.last_ms and (c != PENDING or t >= start + self.wait_ms)), None)
        if ending is None and passed < start + self.last_ms:
            return [], {"start": start}, rest, start + self.last_ms  # what was pending in time decides nothing
        at, code = ending or (start + self.last_ms, PENDING)
        outcome = "done" if code == DONE else "timed_out" if code == PENDING else "failed"
        until = start + self.last_ms + self.keep_ms
        kept = ({"start": start, "until": until}, [], until) if passed < until else (None, [], None)
        return [(key_of(key), outcome, at)], *kept


def poll_outcomes(polls: DataFrame, wait_ms: int = 30_000, interval_ms: int = 1_000, keep_ms: int = 86_400_000, lateness: str = "10 minutes") -> DataFrame:
    """One outcome for each `media_id` of a stream of polls `media_id, seq, ts, code`: `outcome, ended_ms`.

    The first poll that ends the wait decides: 200 is done, 206 from `wait_ms` on timed out, another code failed. A medium
    that no poll has ended one poll `interval_ms` after the wait timed out at that moment, whether polls go on or stop.
    Polls up to `keep_ms` after that change nothing; later ones would start a new wait.
    """
    rows = slotted(polls.withWatermark("ts", lateness), "media_id", ["code"])
    return folded(rows, PollWait(wait_ms, interval_ms, keep_ms), "media_id string, outcome string, ended_ms bigint")


class Delivery(SlotProcessor):
    """The steps of one post. Its last statuses are told when no attempt came for `idle_ms`; then it is forgotten."""

    columns = ["post_id", "step", "status", "attempts"]
    acts_by_clock = True

    def __init__(self, retries: int, idle_ms: int):
        self.retries, self.idle_ms = retries, idle_ms

    def key_due(self, key, state, due, rest, passed):
        state = state or {"last": None, "steps": {}}
        held = {int(k): v for k, v in state["steps"].items()}
        for _, _, text in due:
            row = json.loads(text)
            tries, fails, done = held.get(row["step"], (0, 0, False))
            if not done and fails < self.retries:
                held[row["step"]] = (tries + 1, fails + (not row["ok"]), bool(row["ok"]))
        last = due[-1][0] if due else state["last"]
        if rest or last is None or passed < last + self.idle_ms:
            return [], {"last": last, "steps": held}, rest, None if last is None else last + self.idle_ms
        out = []
        for step, (tries, fails, done) in sorted(held.items()):
            if step > 1 and not (step - 1 in held and held[step - 1][2]):
                out.append((key_of(key), step, "blocked", 0))
            else:
                out.append((key_of(key), step, "done" if done else "gave_up" if fails >= self.retries else "retry", tries))
        return out, None, [], None


def delivery_outcomes(attempts: DataFrame, retries: int = 5, idle_ms: int = 86_400_000, lateness: str = "10 minutes") -> DataFrame:
    """`post_id, step, status, attempts` of each post of a stream `post_id, step, seq, ts, ok`, once it is `idle_ms` without attempts.

    A step runs until it succeeds or has failed `retries` times; it is blocked, with no attempts, if the step before it is not done.
    """
    rows = slotted(attempts.withWatermark("ts", lateness), "post_id", ["step", "ok"])
    return folded(rows, Delivery(retries, idle_ms), "post_id bigint, step bigint, status string, attempts bigint")
