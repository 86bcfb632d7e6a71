"""Keyed state kept by slots of many keys.

A call from Python to the state store costs about as much as judging a hundred rows. So keys are dealt into SLOTS
groups by hash; what a slot's rows of one batch say is stored as one entry, and a timer acts for all keys of its slot.
Keys and rows travel as JSON, which gives back whole numbers, strings and nulls as they were.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOTS = 1024


def slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("slot")


def key_text(key: str) -> Column:
    """A key as JSON, `key_of` gives it back."""
    return F.to_json(F.array(key), {"ignoreNullFields": "false"}).alias("key")


def key_of(text: str):
    return json.loads(text)[0]


def slotted(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`slot, ts, key, ts_ms, seq, row` of a stream with a watermark on `ts`; `row` is the JSON of `fields`."""
    row = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("row")
    return rows.select(slot(key), "ts", key_text(key), F.unix_millis("ts").alias("ts_ms"), F.col("seq").cast("bigint").alias("seq"), row)


class SlotProcessor(StatefulProcessor):
    """Rows of all keys of a slot wait until the watermark has passed them.

    A subclass judges, in `key_due`, one key's due rows in order of `(ts_ms, seq)` and the state it had, and says what it emits,
    which state and rows stay, and when it is to be asked again at the latest. A key without a state is forgotten.
    """

    columns: list[str] = []

    def key_due(self, key: str, state: dict | None, due: list[tuple], rest: list[tuple], passed: int) -> tuple[list[tuple], dict | None, list[tuple], int | None]:
        """`due` and `rest` are `(ts_ms, seq, row)`; gives output tuples, the new state, rows that go on waiting, and a time."""
        raise NotImplementedError

    def wants(self, states: dict[str, dict], key: str) -> bool:
        """Whether a row that arrives now counts."""
        return True

    acts_by_clock = False  # whether states without rows have times of their own
    filters = False  # whether `wants` is to be asked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.acted = handle, {}
        self.waiting = handle.getListState("waiting", "rows string")
        self.states = handle.getMapState("states", "key string", "state string")

    def _states(self) -> dict[str, dict]:
        return {k[0]: json.loads(v[0]) for k, v in self.states.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, states = None, self._states() if self.filters else {}
        for pdf in rows:
            new = [(k, int(t), int(s), r) for k, t, s, r in zip(*(pdf[c] for c in ("key", "ts_ms", "seq", "row")), strict=True)]
            new = [x for x in new if self.wants(states, x[0])] if self.filters else new
            if new:
                self.waiting.appendValue((json.dumps(new),))
                first = min([t for _, t, _, _ in new] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self.acted.get(key[0]) == passed:
            return iter([])  # another timer of this slot has acted up to the same moment
        self.acted[key[0]] = passed
        held: dict[str, list[tuple]] = {}
        for (text,) in self.waiting.get():
            for k, *row in json.loads(text):
                held.setdefault(k, []).append(tuple(row))
        concerned = {k: rows for k, rows in held.items() if any(r[0] <= passed for r in rows)}
        if self.acts_by_clock or 4 * len(concerned) > SLOTS:
            states = self._states()
        else:
            states = {k: json.loads(v[0]) for k in concerned if (v := self.states.getValue((k,))) is not None}
        if self.acts_by_clock:
            concerned |= {k: held.get(k, []) for k in states}
        out, times = [], []
        for k, rows in concerned.items():
            rows.sort()
            due, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
            before = states.get(k)
            kept = json.dumps(before)
            emitted, after, held[k], at = self.key_due(k, before, due, rest, passed)
            out += emitted
            times += [at] if at is not None else []
            if after is None and before is not None:
                self.states.removeKey((k,))
            elif after is not None and (before is None or json.dumps(after) != kept):
                self.states.updateValue((k,), (json.dumps(after),))
        if concerned:
            left = [(k, *r) for k, rows in held.items() for r in rows]
            if left:
                self.waiting.put([(json.dumps(left[i : i + 10_000]),) for i in range(0, len(left), 10_000)])
            else:
                self.waiting.clear()
        times += [t for rows in held.values() for t, *_ in rows]
        if times:
            self.handle.registerTimer(min(times))
        return iter([pd.DataFrame(out, columns=self.columns)]) if out else iter([])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Keys' states before their first rows: JSON in the column `state`."""
        for k, state in zip(initialState["key"], initialState["state"], strict=True):
            self.states.updateValue((k,), (state,))

    def close(self) -> None:
        pass


def folded(rows: DataFrame, processor: SlotProcessor, schema: str, start: DataFrame | None = None) -> DataFrame:
    """What a processor gives of `slotted` rows."""
    return rows.groupBy("slot").transformWithStateInPandas(
        processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", initialState=None if start is None else start.groupBy("slot")
    )
