"""Streams that keep state of their own for each key: the last turns of a thread, the state of an escalation.

State lives in the state store and in its checkpoint, so a stream that is stopped or loses executors goes on where it
was. What each key sends is numbered; a reader takes the row of the highest number, so a batch that is repeated changes nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyforge.streaming.ingest import ingest

# Spark hands processors to a worker of the driver as well, which may not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The store that state of this kind needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastTurns(StatefulProcessor):
    """The `keep` last turns of a thread; a turn that has not been followed for `seconds` is forgotten."""

    def __init__(self, keep: int, seconds: int):
        self.keep, self.seconds = keep, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string", ttlDurationMs=self.seconds * 1000)
        self.number = handle.getValueState("number", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = [tuple(x) for x in self.turns.get()] if self.turns.exists() else []
        last = set(before)
        for frame in rows:  # no more than the last turns are held of each frame either
            last.update(zip(frame["turn"].astype("int64").tolist(), frame["role"].where(frame["role"].notna(), None).tolist(), frame["text"].where(frame["text"].notna(), None).tolist()))
            last = set(_latest(last, self.keep))
        now = _latest(last, self.keep)
        if now == before:
            return
        self.turns.put(now)
        number = (self.number.get()[0] if self.number.exists() else 0) + 1
        self.number.update((number,))
        yield pd.DataFrame([(key[0], number, *x) for x in now], columns=["thread", "number", "turn", "role", "text"])

    def close(self) -> None:
        pass


def _latest(turns: set[tuple], keep: int) -> list[tuple]:
    return sorted(turns, key=lambda x: (x[0], x[1] or "", x[2] or ""))[-keep:]


def bounded_history(turns: DataFrame, keep: int = 20, seconds: int = 30 * 86400) -> DataFrame:
    """A stream of (thread long, turn long, role, text) -> (thread, number, turn, role, text): all kept turns of a thread whenever they change."""
    grouped = turns.where("turn IS NOT NULL").groupBy("thread")
    schema = "thread long, number long, turn long, role string, text string"
    return grouped.transformWithStateInPandas(LastTurns(keep, seconds), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime")


class Escalation(StatefulProcessor):
    """A case's first request, and the first decision after it, whatever order events come in.

    Decisions that no request precedes yet wait for one; once the watermark has passed them none can come, and a timer lets them go.
    So state is as small as what may still be late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        at = "time long, seq long"
        self.requested = handle.getValueState("requested", at)
        self.decision = handle.getValueState("decision", f"{at}, event string")
        self.waiting = handle.getListState("waiting", f"{at}, event string")
        self.sent = handle.getValueState("sent", "n long, state string")

    def _held(self, state: Any) -> list[tuple]:
        return [tuple(state.get())] if state.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        requests, decisions = self._held(self.requested), self._held(self.decision)
        if self.waiting.exists():
            decisions += [tuple(x) for x in self.waiting.get()]
        for frame in rows:
            micros = frame["time"].to_numpy("datetime64[us]").astype("int64").tolist()
            for time, seq, event in zip(micros, frame["seq"].astype("int64").tolist(), frame["event"].tolist()):
                if event == "request":
                    requests.append((time, seq))
                elif event in ("approve", "deny"):
                    decisions.append((time, seq, event))
            requests = sorted(requests)[:1]
        first = requests[0] if requests else None
        after = [d for d in decisions if first and d[:2] > first]
        self._keep(first, min(after, default=None), [d for d in decisions if not (first and d[:2] > first)], timerValues)
        state = "open" if not first else "pending_approval" if not after else "escalated" if min(after)[2] == "approve" else "denied"
        number, before = self.sent.get() if self.sent.exists() else (0, None)
        if state != before:
            self.sent.update((number + 1, state))
            yield pd.DataFrame([(key[0], number + 1, state)], columns=["case_id", "number", "state"])

    def _keep(self, first: tuple | None, decision: tuple | None, waiting: list[tuple], timers: Any) -> None:
        passed = timers.getCurrentWatermarkInMs() * 1000
        waiting = sorted({d for d in waiting if d[0] >= passed})
        if first:
            self.requested.update(first)
        if decision:
            self.decision.update(decision)
        elif self.decision.exists():
            self.decision.clear()
        if waiting:
            self.waiting.put(waiting)
            self.handle.registerTimer(waiting[-1][0] // 1000 + 1)
        elif self.waiting.exists():
            self.waiting.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        left = [d for d in held if d[0] >= timerValues.getCurrentWatermarkInMs() * 1000]
        if left:
            self.waiting.put(left)
        elif held:
            self.waiting.clear()
        yield pd.DataFrame({"case_id": pd.Series([], dtype="int64"), "number": pd.Series([], dtype="int64"), "state": pd.Series([], dtype=object)})

    def close(self) -> None:
        pass


def escalations(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """A stream of (case_id long, time timestamp, seq long, event string) -> (case_id, number, state) whenever a case's state changes.

    Events count by time and then seq; those later than `lateness` behind the latest are dropped.
    """
    grouped = events.where("time IS NOT NULL").withWatermark("time", lateness).groupBy("case_id")
    return grouped.transformWithStateInPandas(Escalation(), outputStructType="case_id long, number long, state string", outputMode="Update", timeMode="EventTime")


def run(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Take in what is new and stop; each batch has a folder of its own, which it replaces when repeated.

    Batches without data are not run: by the clock of the machine there would always be another one.
    """
    conf = stream.sparkSession.conf
    settings = [STORE, ("spark.sql.streaming.noDataMicroBatches.enabled", "false")]
    before = [(name, conf.get(name, None)) for name, _ in settings]
    for name, value in settings:
        conf.set(name, value)
    try:
        ingest(stream, target, checkpoint)
    finally:
        for name, value in before:
            conf.unset(name) if value is None else conf.set(name, value)


def current(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The rows of each key's highest number."""
    rows = spark.read.parquet(target).drop("batch")
    last = rows.groupBy(key).agg(F.max("number").alias("last"))
    return rows.join(last, key).where("number = last").drop("last")
