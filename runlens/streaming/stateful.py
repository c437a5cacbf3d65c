"""Streaming reassembly of batches from their parts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


ROWS_PER_FRAME = 10_000


class _Reassemble(StatefulProcessor):
    """Holds the parts of one batch in the state store until all arrived or its time is up."""

    COLUMNS = ["batch_id", "sub_batch_id", "result", "status"]

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "sub_batch_id long", "result string")
        self.meta = handle.getValueState("meta", "received int, closed boolean")

    def _frames(self, batch_id, parts, status) -> Iterator[pd.DataFrame]:
        parts = iter(parts)
        while rows := [(batch_id, *part, status) for part in islice(parts, ROWS_PER_FRAME)]:
            yield pd.DataFrame(rows, columns=self.COLUMNS)

    def _release(self, batch_id, status) -> Iterator[pd.DataFrame]:
        held = ((key[0], value[0]) for key, value in self.parts.iterator())
        yield from self._frames(batch_id, held, status)
        self.parts.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        received, closed = self.meta.get() if self.meta.exists() else (0, False)
        newest = max((int(t) for t in self.handle.listTimers()), default=self.timeout_ms) - self.timeout_ms
        for batch in rows:
            newest = max(newest, int(batch["ts"].max().timestamp() * 1000))
            held: dict[int, str] = {}
            for at, (sub, result, expected) in enumerate(
                zip(batch["sub_batch_id"], batch["result"], batch["expected"])
            ):
                if closed:
                    late = zip(batch["sub_batch_id"][at:], batch["result"][at:])
                    yield from self._frames(key[0], late, "late")
                    break
                if sub not in held and not self.parts.containsKey((sub,)):
                    received += 1
                held[sub] = result
                closed = received >= expected
            for sub, result in held.items():
                self.parts.updateValue((sub,), (result,))
            if closed and self.parts.exists():
                yield from self._release(key[0], "complete")
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + self.timeout_ms)
        self.meta.update((received, closed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, closed = self.meta.get()
        if closed:  # all rows the watermark still lets through are labelled: forget the batch
            self.meta.clear()
            return
        yield from self._release(key[0], "timeout")
        self.meta.update((0, True))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.timeout_ms)

    def close(self) -> None:
        pass


def live_reassemble(stream: DataFrame, timeout_ms: int) -> DataFrame:
    """Parts ``(batch_id, sub_batch_id, result, expected, ts)`` released per batch.

    ``complete``: all expected parts arrived. ``timeout``: event time passed ``timeout_ms`` after
    the newest part. ``late``: the batch had been released before. A row's label depends on the rows before
    it, not on how they are grouped for Python; of a repeated part the later result counts. A released batch is
    forgotten once event time is another ``timeout_ms`` further. The stream needs a watermark.
    """
    kind = stream.schema["batch_id"].dataType.simpleString()
    return stream.groupBy("batch_id").transformWithStateInPandas(
        statefulProcessor=_Reassemble(timeout_ms),
        outputStructType=f"batch_id {kind}, sub_batch_id long, result string, status string",
        outputMode="Append",
        timeMode="EventTime",
    )


def with_open_batches(released: DataFrame, parts: DataFrame) -> DataFrame:
    """Released parts and, labelled ``timeout``, those of batches that were still open when the input ended; of a
    repeated part the later result counts. ``parts`` is the stream's input as a table."""
    kept = parts.join(released.select("batch_id").distinct(), "batch_id", "left_anti")
    last = kept.groupBy("batch_id", "sub_batch_id").agg(F.max_by("result", "ts").alias("result"))
    return released.unionByName(last.select("batch_id", "sub_batch_id", "result", F.lit("timeout").alias("status")))


class _NumberArrivals(StatefulProcessor):
    """Remembers of each key its last arrival, the number of its session and the position inside."""

    def __init__(self, keys: list[str], gap_us: int, size: int):
        self.keys, self.gap_us, self.size = keys, gap_us, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("arrivals", "last_us long, session_no long, position long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = [(frame["at_us"].to_numpy(np.int64), frame["item"].to_numpy()) for frame in rows]
        at, items = (np.concatenate(x) for x in zip(*told))
        order = np.lexsort((items, at))
        at, items = at[order], items[order]
        last, session, position = self.state.get() if self.state.exists() else (None, 0, -1)
        late = np.zeros(len(at), bool) if last is None else at < last
        on = np.flatnonzero(~late)
        sessions, positions = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if len(on):
            seen = at[on]
            before = np.concatenate([[seen[0] - self.gap_us if last is None else last], seen[:-1]])
            opens = seen - before >= self.gap_us
            sessions[on] = session + np.cumsum(opens)
            # Positions count on from the newest row that opened a session, or from the state.
            place = np.arange(len(on))
            began = np.maximum.accumulate(np.where(opens, place, -1))
            positions[on] = np.where(began >= 0, place - began, position + 1 + place)
            self.state.update((int(seen[-1]), int(sessions[on[-1]]), int(positions[on[-1]])))
        for start in range(0, len(at), ROWS_PER_FRAME):
            part = slice(start, start + ROWS_PER_FRAME)
            kept = ~late[part]
            yield pd.DataFrame({
                **{name: [value] * len(items[part]) for name, value in zip(self.keys, key)},
                "item": items[part],
                "session_no": sessions[part],
                "batch_no": positions[part] // self.size,
                "status": np.where(kept, "numbered", "late"),
            })

    def close(self) -> None:
        pass


def live_gap_batches(
    stream: DataFrame, keys: list[str], item: str, gap_seconds: float, size: int, ts: str = "ts"
) -> DataFrame:
    """(keys, item, session_no, batch_no, status) of every arrival, as it arrives: the streaming ``gap_batches``.

    A session ends when nothing arrived for ``gap_seconds``; inside, every ``size`` arrivals make a batch. Arrivals of a trigger are
    taken in the order of time and ``item`` (a whole number); ``late`` are those older than what earlier triggers
    numbered, which get no numbers. State is one row a key; a trigger holds two numbers for each of
    a key's new arrivals, so its size bounds memory. A null time cannot be placed and raises an error.
    """
    gap_us = int(round(gap_seconds * 1_000_000))
    told = stream.select(
        *keys, F.col(item).cast("bigint").alias("item"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us")
    )
    schema = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    numbered = told.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_NumberArrivals(keys, gap_us, size),
        outputStructType=f"{schema}, item long, session_no long, batch_no long, status string",
        outputMode="Append",
        timeMode="None",
    )
    on_time = F.col("status") == "numbered"
    return numbered.select(
        *keys, "item", *[F.when(on_time, F.col(c)).alias(c) for c in ("session_no", "batch_no")], "status"
    )
