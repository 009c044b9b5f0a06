"""Attempts at a response as they arrive: the first valid one wins, in whatever order they come."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioforge.operators.validation import MAX_ATTEMPTS

DECIDED = "{key}, status string, attempts int"
_STATE = "seen long, best int, tried int, done boolean"


class FirstValid(StatefulProcessor):
    """State of one document: which attempts have come, the first valid one, the last one tried, and whether it is decided.

    A document is decided when no attempt that could still come would change the answer: all before the
    first valid one have come, or all have and none is valid. A document that waits for attempts that do
    not come is decided by a timer, by what is there. What comes later is not looked at.
    """

    def __init__(self, key: str, most: int, wait_ms: int) -> None:
        self.key, self.most, self.wait_ms = key, most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seen, best, tried, done = self.state.get() if self.state.exists() else (0, 0, 0, False)
        if done:
            return
        for row in rows:
            if row.attempt is None or not 1 <= row.attempt <= self.most:
                continue
            seen, tried = seen | 1 << row.attempt, max(tried, row.attempt)
            if row.valid and (not best or row.attempt < best):
                best = row.attempt
        if not tried:
            return
        needed = range(1, best or self.most + 1)
        done = all(seen >> i & 1 for i in needed)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((seen, best, tried, done))
        if done:
            yield self._answer(key, best, tried)
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        seen, best, tried, done = self.state.get()
        if not done:
            self.state.update((seen, best, tried, True))
            yield self._answer(key, best, tried)

    def _answer(self, key, best: int, tried: int) -> Row:
        return Row(**{self.key: key[0], "status": "success" if best else "failed", "attempts": best or tried})

    def close(self) -> None:
        pass


def resolve_stream(validated: DataFrame, key: str = "doc_id", most: int = MAX_ATTEMPTS, wait_ms: int = 60_000) -> DataFrame:
    """(key, status, attempts) of each document of a stream with key, attempt and valid, once it is decided.

    The same answers as :func:`folioforge.operators.validation.resolve_attempts`. The state needs
    a store with column families: set ``spark.sql.streaming.stateStore.providerClass`` to the one of RocksDB.
    """
    rows = validated.select(key, "attempt", "valid")
    schema = DECIDED.format(key=f"{key} {dict(rows.dtypes)[key]}")
    return rows.groupBy(key).transformWithState(statefulProcessor=FirstValid(key, most, wait_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
