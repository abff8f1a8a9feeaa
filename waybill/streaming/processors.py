"""State processors: small values in the stream's state store, per key or per page of keys.

A call to the state store costs far more than an update, so envelopes that share a page are
loaded, folded and saved together, and a page has one timer.

Spark also loads these in a driver-side worker that does not see files added to
the session, so this module is pickled by value.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

FINAL = ("succeeded", "failed")

STATE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("current_actor_idx", T.IntegerType()),
        T.StructField("current_actor_name", T.StringType()),
        T.StructField("actors", T.ArrayType(T.StringType())),
        T.StructField("progress", T.DoubleType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("deadline_ms", T.LongType()),
        T.StructField("version", T.LongType()),
    ]
)

SNAPSHOT = T.StructType(
    [T.StructField("id", T.StringType())] + [f for f in STATE.fields if f.name != "deadline_ms"]
)

PAGE = T.StructType([
    T.StructField("rows", T.ArrayType(T.StructType([T.StructField("id", T.StringType()),
                                                    *STATE.fields])))
])
_NAMES = [f.name for f in STATE.fields]
_SHOWN = [f.name for f in SNAPSHOT.fields[1:]]

WEIGHTS = {"received": 10.0, "processing": 50.0, "completed": 100.0}


def in_order(rows: Iterator[Row]) -> Iterator[Row]:
    """One key's rows of a micro-batch by sequence number.

    They are held together for that; ``stream_updates(max_files=...)`` bounds them.
    """
    return iter(sorted(rows, key=lambda r: r.seq))


def apply_update(state: dict, row: dict) -> dict:
    """State after one update; a final status absorbs what follows."""
    if state["status"] in FINAL:
        return state
    new = dict(state)
    actors = list(row["actors"]) if row["actors"] is not None else []
    if len(actors) > len(state["actors"] or []):
        new["actors"] = actors
    route = new["actors"] or []
    if row["status"]:
        new["status"] = row["status"]
    for name in ("error", "message"):
        if row[name]:
            new[name] = row[name]
    if row["result"] is not None:
        new["result"] = row["result"]
    idx = row["current_actor_idx"]
    if idx is not None:
        new["current_actor_idx"] = int(idx)
        if 0 <= idx < len(route):
            new["current_actor_name"] = route[int(idx)]
    raw = 0.0
    if row["status"] in FINAL:
        raw = 100.0
    elif idx is not None and route:
        raw = (idx * 100 + WEIGHTS.get(row["envelope_state"], 0.0)) / len(route)
    new["progress"] = max(state["progress"], min(raw, 100.0))
    if new["updated_at"] is None or row["ts"] > new["updated_at"]:
        new["updated_at"] = row["ts"]
    return new


def _empty() -> dict:
    return {f.name: None for f in STATE.fields} | {"status": "pending", "progress": 0.0,
                                                   "version": 0}


def next_due(page: dict) -> int | None:
    """Earliest deadline of a page's open envelopes."""
    return min((state["deadline_ms"] for state in page.values()
                if state["deadline_ms"] is not None and state["status"] not in FINAL), default=None)


class StatusFold(StatefulProcessor):
    """The states of a page of envelopes, and a timer at the page's earliest deadline."""

    def init(self, handle) -> None:
        self._handle = handle
        self._page = handle.getValueState("page", PAGE)

    def _load(self) -> dict:
        """The page's states by envelope id."""
        value = self._page.get()
        rows = [] if value is None else value[0]
        return {row[0]: dict(zip(_NAMES, row[1:])) for row in rows}

    def _save(self, page: dict, due: int | None, passed: bool = False) -> None:
        """Store a page and move its timer, which stood at ``due`` and may have passed."""
        self._page.update(([(i, *[state[n] for n in _NAMES]) for i, state in page.items()],))
        now = next_due(page)
        if now != due:
            if due is not None and not passed:
                self._handle.deleteTimer(due)
            if now is not None:
                self._handle.registerTimer(now)

    @staticmethod
    def _row(id_: str | None, state: dict) -> Row:
        return Row(**({"id": id_} | {n: state[n] for n in _SHOWN}))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        page = self._load()
        due, touched = next_due(page), {}
        for row in in_order(rows):
            row = row.asDict()
            id_ = row["envelope_id"]
            state = page.get(id_)
            if state is None:
                state = _empty()
            if row.get("deadline") is not None and state["deadline_ms"] is None:
                state["deadline_ms"] = int(row["deadline"].timestamp() * 1000)
            page[id_] = touched[id_] = apply_update(state, row)
        if touched:
            for state in touched.values():
                state["version"] += 1
            self._save(page, due)
            for id_, state in touched.items():
                yield self._row(id_, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        page, due = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        # one timer stands for all deadlines that the watermark has passed by now
        until = max(due, timerValues.getCurrentWatermarkInMs() - 1)
        late = [(i, state) for i, state in page.items() if state["status"] not in FINAL
                and state["deadline_ms"] is not None and state["deadline_ms"] <= until]
        for _, state in late:
            at = datetime.fromtimestamp(state["deadline_ms"] / 1000)
            state |= {"status": "failed", "error": "envelope timed out", "updated_at": at,
                      "progress": 100.0, "version": state["version"] + 1}
        if late:
            self._save(page, due, passed=True)
            for id_, state in late:
                yield self._row(id_, state)

    def close(self) -> None:
        pass


class AttemptCount(StatefulProcessor):
    """Counts deliveries per key."""

    def init(self, handle) -> None:
        self._count = handle.getValueState("n", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        value = self._count.get()
        n = 0 if value is None else value[0]
        for row in in_order(rows):
            n += 1
            yield Row(**row.asDict(), attempt=n)
        self._count.update((n,))

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])
