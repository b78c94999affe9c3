"""Agents that fall silent, told by a timer of their own instead of by the next message of somebody else.

``silences`` keeps state by agent with ``transformWithState``. Each agent has a timer that its next
message puts off; when it runs out, the agent is reported. Two clocks are there:

- ``clock="event"``: the watermark. Sessions of an agent end by a gap in event time; several may
  be open at once while late messages can still come, and each is reported when the watermark
  passes its end. The result is that of sessions over all messages at once.
- ``clock="processing"``: the wall clock. The time runs from the arrival of the agent's last
  message, so an agent is reported although nothing at all arrives any more: Spark runs batches
  without input for timers. An agent that comes back is reported as ``back`` with what was last seen of
  it; that it had been silent is remembered for ``remember`` (state with a time to live).

Messages become partial sessions before the shuffle (agent, first, last, count), so a busy agent
sends a row for each Arrow batch and not for each message, and its state holds open sessions
only. Messages without agent or time are left out. Timers and state live in the checkpoint: a
stream that starts again reports nothing twice, and reports what fell due while it was down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.frames import micros
from .jobs import run_available, write_batch

#: State with timers is kept by RocksDB.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_SESSION = "first bigint, last bigint, n bigint"


def microseconds(duration: str) -> int:
    """Length of an interval such as ``24 hours``."""
    number, unit = duration.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.removesuffix("s")]
    return round(float(number) * seconds * 1_000_000)


def partial_sessions(messages: DataFrame, gap: int, agent_col: str = "agent_id", time_col: str = "created_at") -> DataFrame:
    """(agent, first, last, n, at): messages of an Arrow batch by agent, parted where ``gap`` microseconds or more lie between two."""
    rows = messages.select(F.col(f"`{agent_col}`").alias("agent"), micros(messages, time_col).alias("us")).where("agent IS NOT NULL AND us IS NOT NULL")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("agent").dictionary_encode()
            agent, us = codes.indices.to_numpy(), batch.column("us").to_numpy()
            order = np.lexsort((us, agent))
            agent, us = agent[order], us[order]
            starts = np.flatnonzero(np.concatenate([[True], (agent[1:] != agent[:-1]) | (us[1:] - us[:-1] >= gap)]))
            ends = np.append(starts[1:], len(us)) - 1
            yield pa.RecordBatch.from_arrays(
                [codes.dictionary.take(pa.array(agent[starts])), pa.array(us[starts]), pa.array(us[ends]), pa.array(ends - starts + 1)],
                ["agent", "first", "last", "n"])

    return rows.mapInArrow(combine, f"agent {dict(rows.dtypes)['agent']}, {_SESSION}").withColumn("at", F.timestamp_micros("last"))


def merged(sessions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (first, last, n) that lie less than the gap apart become one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(sessions):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class BySessions(StatefulProcessor):
    """Open sessions of an agent; the watermark is the clock."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _SESSION)

    def _due(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        now = merged(before + [(r["first"], r["last"], r["n"]) for r in rows], self.gap)
        old, new = {self._due(s[1]) for s in before}, {self._due(s[1]) for s in now}
        for due in old - new:
            self.handle.deleteTimer(due)
        for due in new - old:
            self.handle.registerTimer(due)
        self.open.put(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, left = expiredTimerInfo.getExpiryTimeInMs(), []
        for first, last, n in (tuple(s) for s in self.open.get()):
            if self._due(last) <= now:
                yield Row(agent=key[0], kind="silent", last=last, n=n)
            else:
                left.append((first, last, n))
        if left:
            self.open.put(left)
        else:
            self.open.clear()


class ByArrival(StatefulProcessor):
    """What was last seen of an agent; the wall clock is the clock."""

    def __init__(self, gap: int, remember: int) -> None:
        self.gap, self.remember = gap // 1000, remember // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint, n bigint, due bigint")
        self.silent = handle.getValueState("silent", "last bigint, n bigint", ttlDurationMs=self.remember)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, n, due = self.seen.get() if self.seen.exists() else (None, 0, None)
        if due is not None:
            self.handle.deleteTimer(due)
        elif self.silent.exists():
            gone = self.silent.get()
            self.silent.clear()
            yield Row(agent=key[0], kind="back", last=gone[0], n=gone[1])
        for r in rows:
            last, n = r["last"] if last is None else max(last, r["last"]), n + r["n"]
        due = timerValues.getCurrentProcessingTimeInMs() + self.gap
        self.handle.registerTimer(due)
        self.seen.update((last, n, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            last, n, _ = self.seen.get()
            self.seen.clear()
            self.silent.update((last, n))
            yield Row(agent=key[0], kind="silent", last=last, n=n)


def silences(messages: DataFrame, silent: str = "24 hours", delay: str = "1 hour", clock: str = "event", remember: str = "30 days",
             agent_col: str = "agent_id", time_col: str = "created_at") -> DataFrame:
    """(agent_id, kind, last_seen, n_messages) of a stream of messages: ``silent``, and by arrival also ``back``."""
    gap = microseconds(silent)
    parts = partial_sessions(messages, gap, agent_col, time_col)
    if clock == "event":
        processor, mode, parts = BySessions(gap), "EventTime", parts.withWatermark("at", delay)
    elif clock == "processing":
        processor, mode = ByArrival(gap, microseconds(remember)), "ProcessingTime"
    else:
        raise ValueError(f"no clock {clock!r}")
    told = parts.groupBy("agent").transformWithState(
        processor, f"agent {dict(parts.dtypes)['agent']}, kind string, last bigint, n bigint", "append", mode)
    return told.select(F.col("agent").alias("agent_id"), "kind", F.timestamp_micros("last").alias("last_seen"), F.col("n").alias("n_messages"))


def silence_stream(messages: DataFrame, path: str, checkpoint: str, silent: str = "24 hours", delay: str = "1 hour", clock: str = "event",
                   remember: str = "30 days", once: bool = True, every: str | None = None):
    """Write the rows of ``silences`` batch by batch; ``every`` is the time between two looks at the timers of a stream that goes on."""
    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        # a look at the timers that finds nothing leaves no file
        if not rows.isEmpty():
            write_batch(rows, f"{path}/rows", batch_id)
        rows.unpersist()

    told = silences(messages, silent, delay, clock, remember)
    return run_available(told.writeStream.outputMode("append").foreachBatch(each), checkpoint, once, every, messages.sparkSession, ROCKSDB)
