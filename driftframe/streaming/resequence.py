"""Bounded re-sequencing of a stream of updates: rows leave in order of time, one for each timestamp.

Spark's own watermark counts in milliseconds, drops late rows without a word and does not emit the last rows of a bounded
stream; here a late row is an error and an end marker flushes what waits. State is one buffer for each log.
"""

from __future__ import annotations

import heapq
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from driftframe import errors
from driftframe.operators.frames import effective_window

SCHEMA = "path string, timestamp long, source_sequence long, signals string"
STATE = "latest long, emitted long, waiting string"


class Buffer:
    """Waiting rows of one log: timestamp -> [largest offset, {signal: [offset, value]}], and a heap of the timestamps."""

    def __init__(self, window: int, most: int, latest: int | None = None, emitted: int | None = None, waiting: dict | None = None):
        if window < 0 or most < 1:
            raise errors.InvalidArgument("the window must not be negative, and the buffer must hold a row")
        self.window, self.most, self.latest, self.emitted, self.waiting = window, most, latest, emitted, waiting or {}
        self.order = sorted(self.waiting)

    def accept(self, ts: int, signal: str, value, offset: int) -> list[tuple]:
        """Takes an update and returns the rows that are then ready."""
        if self.emitted is not None and ts <= self.emitted:
            raise errors.LateTimestamp(f"{ts} after {self.emitted} was emitted", timestamp=ts, emitted_through=self.emitted)
        if ts not in self.waiting:
            heapq.heappush(self.order, ts)
        row = self.waiting.setdefault(ts, [offset, {}])
        row[0] = max(row[0], offset)
        if signal not in row[1] or row[1][signal][0] <= offset:
            row[1][signal] = [offset, value]
        self.latest = ts if self.latest is None else max(self.latest, ts)
        ready = self.pop(self.latest - self.window)
        if len(self.waiting) > self.most:
            raise errors.ReorderBufferLimit(f"{len(self.waiting)} timestamps waiting, {self.most} allowed", pending=len(self.waiting), limit=self.most)
        return ready

    def pop(self, before: int | None = None) -> list[tuple]:
        """The rows of timestamps below before, or all."""
        out = []
        while self.order and (before is None or self.order[0] < before):
            t = heapq.heappop(self.order)
            offset, signals = self.waiting.pop(t)
            out.append((t, offset, {s: v[1] for s, v in sorted(signals.items())}))
            self.emitted = t
        return out

    def flush(self) -> list[tuple]:
        return self.pop()


def resequenced(updates: DataFrame, window: int = 5_000_000, most: int = 100_000, regression: int = 0) -> DataFrame:
    """(path, timestamp, source_sequence, signals as JSON) of a streaming updates (path, timestamp, signal, value, seq).

    value may have any type: number, text, boolean or array. A row leaves once a timestamp more than window later has come; regression,
    how far timestamps are known to step back, widens it. A row with a null timestamp ends its log. Rows of
    one micro-batch are taken in order of seq.
    """
    window = effective_window(window, regression)

    def step(key, frames, state):
        latest, emitted, waiting = state.get if state.exists else (-1, -1, "{}")
        held = Buffer(window, most, latest if latest != -1 else None, emitted if emitted != -1 else None, {int(k): v for k, v in json.loads(waiting).items()})
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out: list[tuple] = []
        for ts, signal, value, seq in zip(rows["timestamp"], rows["signal"], rows["value"], rows["seq"]):
            out += held.flush() if pd.isna(ts) else held.accept(int(ts), signal, json.loads(value).get("value"), int(seq))
        state.update((-1 if held.latest is None else held.latest, -1 if held.emitted is None else held.emitted, json.dumps(held.waiting)))
        yield pd.DataFrame([(key[0], t, s, json.dumps(x)) for t, s, x in out], columns=["path", "timestamp", "source_sequence", "signals"])

    rows = updates.withColumn("value", F.to_json(F.struct("value")))  # one column for any type
    return rows.groupBy("path").applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)
