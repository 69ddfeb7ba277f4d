"""Streaming lock-out counter: ``transformWithState`` keyed by user.

State per user is one value (count, expires, newest) and a timer ``keep`` after
the user's newest attempt, in event time: when the stream's time has passed it,
an idle user leaves the store.  A counter means nothing once its window is
over, so what a user loses by that is only that an attempt which comes still
later isn't told from a new one.  ``keep=None`` keeps all users for ever.

The stream's time is the newest attempt seen.  The operator itself reads a plain
copy of the attempts' times, so no attempt is filtered for being late: one
earlier than an attempt that an earlier micro-batch has already counted is
returned with result ``late`` and counter 0.

A user's attempts of a micro-batch come in chunks.  Of every chunk only times,
ids and outcomes stay (17 bytes an attempt); they are sorted by (time, id)
together, and results leave in chunks again.  Attempts without a user count
as one user, as in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridwatch.session import ship_package
from gridwatch.operators.lockouts import DEFAULT_MAX_FAILED, DEFAULT_WINDOW, RESULT_SCHEMA, _as_micros, _fold

STATE_SCHEMA = "count long, expires long, newest long"
#: How long an idle user's state stays, and rows of a result chunk.
KEEP, CHUNK = timedelta(days=30), 50_000
#: The column that carries the stream's time.
CLOCK = "__clock"
#: Name of the state variable.
STATE = "counter"


class LockoutCounter(StatefulProcessor):
    """The rule of ``operators.lockouts`` for one user's chunks."""

    def __init__(self, window_us: int, max_failed: int, keep_ms: int | None):
        self.window_us, self.max_failed, self.keep_ms = window_us, max_failed, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(STATE, STATE_SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ts, ids, outcome = (np.concatenate(c) for c in zip(*(
            (_as_micros(chunk["ts"]), chunk["attempt_id"].to_numpy(), _outcomes(chunk["success"])) for chunk in rows), strict=True))
        order = np.lexsort((ids, ts))
        ts, ids, outcome = ts[order], ids[order], outcome[order]
        user, mem, newest = key[0], {}, None
        if self.state.exists():
            count, expires, newest = self.state.get()
            if count:
                mem[user] = (count, expires)
        first = 0 if newest is None else int(np.searchsorted(ts, newest, "left"))
        counter, result = np.zeros(len(ts), np.int64), np.full(len(ts), "late", object)
        counter[first:], result[first:] = _fold([user] * (len(ts) - first), ts[first:], outcome[first:] == 1, self.window_us, self.max_failed, mem)
        count, expires = mem.get(user, (0, 0))
        last = int(ts[-1] if newest is None else max(ts[-1], newest))
        self.state.update((int(count), int(expires), last))
        if self.keep_ms is not None and last != newest:
            if newest is not None:
                self.handle.deleteTimer(newest // 1000 + self.keep_ms)
            self.handle.registerTimer(last // 1000 + self.keep_ms)
        for k in range(0, len(ts), CHUNK):
            part = slice(k, k + CHUNK)
            success = pd.array([None if o < 0 else bool(o) for o in outcome[part]], "boolean")
            yield pd.DataFrame({"user": user, "ts": pd.to_datetime(ts[part], unit="us"), "attempt_id": ids[part], "success": success,
                                "counter": counter[part], "result": result[part]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _outcomes(success: pd.Series) -> np.ndarray:
    """1, 0, or -1 for null."""
    return np.where(success.isna(), -1, success.eq(True)).astype(np.int8)


def lockout_stream(attempts: DataFrame, window: timedelta = DEFAULT_WINDOW,
                   max_failed: int = DEFAULT_MAX_FAILED, keep: timedelta | None = KEEP) -> DataFrame:
    """Counter and result of every attempt of a stream; needs the RocksDB state
    store (``apply_defaults``) and the UTC session zone."""
    ship_package(attempts.sparkSession)
    keep_ms = None if keep is None else int(keep / timedelta(milliseconds=1))
    counter = LockoutCounter(int(window / timedelta(microseconds=1)), max_failed, keep_ms)
    if keep is not None:
        attempts = attempts.withColumn(CLOCK, F.col("ts")).withWatermark(CLOCK, "0 seconds").drop(CLOCK)
    return attempts.groupBy("user").transformWithStateInPandas(
        counter, RESULT_SCHEMA, "Append", "None" if keep is None else "EventTime")
