"""Keyed state machines: one rule of a machine for streams (state with timers, kept through restarts) and for batches.

A batch is dealt by key and sorted, and streams through its task with the state of one key at a time, so a key may have any number of rows. On a stream the same
rule runs in a stateful processor over RocksDB state; rows of a micro-batch are taken in their order, and timers do what silence must.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TaskMachine:
    """A task's life: events enqueue, start, checkpoint (progress), pause, resume, cancel, succeed, partial, fail, retry.

    Requests to pause or cancel a running task take effect at its next checkpoint or end. Progress is 0 to 99 until it is done. A running task without an event
    for longer than ``lease_seconds`` has lost its worker: it is queued again from the beginning. Events that a state doesn't allow are counted, not followed.
    """

    state = "status string, progress int, attempt int, cancel boolean, pause boolean, n_events long, rejected long, last long"
    START = (None, 0, 0, False, False, 0, 0, 0)

    def __init__(self, lease_seconds: int):
        self.lease = lease_seconds * 1_000_000

    def expired(self, s: tuple, micros: int) -> bool:
        return s[0] == "running" and micros - s[7] > self.lease

    def recovered(self, s: tuple) -> tuple:
        return ("queued", 0, s[2], False, False, *s[5:])

    def step(self, s: tuple, event: str, progress: float | None, micros: int) -> tuple:
        if self.expired(s, micros):
            s = self.recovered(s)
        status, done, attempt, cancel, pause, n, rejected, _ = s
        if event == "enqueue" and status is None:
            status = "queued"
        elif event == "start" and status == "queued":
            status, attempt = "running", attempt + 1
        elif event in ("checkpoint", "succeed", "partial") and status == "running":
            if cancel or pause:
                status, pause = "cancelled" if cancel else "paused", False
            elif event == "checkpoint":
                done = max(0, min(99, math.floor((progress or 0.0) + 0.5)))
            else:
                status, done = "succeeded" if event == "succeed" else "partial", 100
        elif event == "fail" and status == "running":
            status, pause = "failed", False
        elif event == "pause" and status in ("queued", "running"):
            status, pause, cancel = ("paused", False, cancel) if status == "queued" else (status, True, False)
        elif event == "cancel" and status in ("queued", "paused", "running"):
            status, cancel, pause = status if status == "running" else "cancelled", True, False
        elif event == "resume" and status == "paused":
            status, cancel, pause = "queued", False, False
        elif event == "retry" and status in ("failed", "cancelled", "partial"):
            status, done, cancel, pause = "queued", 0, False, False
        else:
            rejected += 1
        return (status, done, attempt, cancel, pause, n + 1, rejected, micros)


def task_table(events: DataFrame, lease_seconds: int, key: str = "task_id") -> DataFrame:
    """events(key, at, sequence, event, progress) to the state of each task after all of them: key, status, progress, attempt, n_events, rejected.

    Events are taken in order of time and sequence. On a stream a row follows each change, and the last one of a task counts. Null progress is 0. Repeated events count as often as they occur.
    """
    machine = TaskMachine(lease_seconds)
    kind = dict(events.dtypes)[key]
    schema = f"{key} {kind}, status string, progress int, attempt int, n_events long, rejected long"
    rows = events.select(key, "at", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), "sequence", "event", F.col("progress").cast("double").alias("progress"))
    order = ["micros", "sequence"]

    def shown(k, s: tuple) -> tuple:
        return (k, *s[:3], *s[5:7])

    if rows.isStreaming:
        columns, held = StructType.fromDDL(schema).names, StructType.fromDDL(machine.state)

        class Tasks(StatefulProcessor):
            def init(self, handle: StatefulProcessorHandle) -> None:
                self.handle, self.held = handle, handle.getValueState("task", held)

            def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
                s = self.held.get() if self.held.exists() else machine.START
                for r in pd.concat(list(rows)).sort_values(order).itertuples(index=False):
                    s = machine.step(tuple(s), r.event, None if pd.isna(r.progress) else r.progress, int(r.micros))
                self.held.update(tuple(s))
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                if s[0] == "running":
                    self.handle.registerTimer((s[7] + machine.lease) // 1000 + 1)
                yield pd.DataFrame([shown(key[0], s)], columns=columns)

            def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
                s = tuple(self.held.get())
                if s[0] == "running":
                    s = machine.recovered(s)
                    self.held.update(s)
                    yield pd.DataFrame([shown(key[0], s)], columns=columns)

            def close(self) -> None:
                pass

        return rows.groupBy(key).transformWithStateInPandas(Tasks(), StructType.fromDDL(schema), "Update", "EventTime")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s, begun = None, machine.START, False
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if not begun or r[0] != now:
                    if begun:
                        out.append(shown(now, s))
                    now, s, begun = r[0], machine.START, True
                s = machine.step(s, r.event, None if pd.isna(r.progress) else r.progress, int(r.micros))
            yield pd.DataFrame(out, columns=names)
        if begun:
            yield pd.DataFrame([shown(now, s)], columns=names)

    names = StructType.fromDDL(schema).names
    rows = rows.filter(F.col(key).isNotNull()).drop("at")
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


def expiring(events: DataFrame, keys: list[str], ts: str, order: str, ttl_seconds: int) -> DataFrame:
    """events(keys, ts, order) with ``round``, the number of the lifetime of its key that a row falls in, and ``first``, whether it began one.

    A key lives for ``ttl_seconds`` from the row that began it; the first row later than that begins the next lifetime. So a nonce is refused while it lives and a
    session ends a fixed time after its start, however often it is used. Keys may be null. On a stream, state goes when its key's time is over.
    """
    ttl = ttl_seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp")).alias("micros")
    rows = events.select(*keys, F.col(ts).alias("at"), micros, F.col(order).alias("sequence"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "at timestamp" if kinds["at"] == "timestamp" else f"at {kinds['at']}", f"sequence {kinds['sequence']}", "round long", "first boolean"])
    names = StructType.fromDDL(schema).names
    if rows.isStreaming:
        life = StructType.fromDDL("began long, round long")

        class Lifetimes(StatefulProcessor):
            def init(self, handle: StatefulProcessorHandle) -> None:
                self.handle, self.held = handle, handle.getValueState("life", life)

            def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
                began, number = self.held.get() if self.held.exists() else (None, 0)
                some = pd.concat(list(rows)).sort_values(["micros", "sequence"])
                rounds, firsts = [], []
                for t in some["micros"].tolist():
                    new = began is None or t > began + ttl
                    if new:
                        began, number = t, number + 1
                    rounds.append(number)
                    firsts.append(new)
                self.held.update((began, number))
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer((began + ttl) // 1000 + 1)
                yield some.drop(columns="micros").assign(round=rounds, first=firsts)[names]

            def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
                began, number = self.held.get()
                self.held.update((None, number))
                return iter([])

            def close(self) -> None:
                pass

        return rows.groupBy(*keys).transformWithStateInPandas(Lifetimes(), StructType.fromDDL(schema), "Append", "EventTime")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, began, number = None, None, 0
        for batch in batches:
            new_key = batch["same"].to_list()
            rounds, firsts = [], []
            for k, t in zip(new_key, batch["micros"].tolist()):
                if k != now:
                    now, began, number = k, None, 0
                new = began is None or t > began + ttl
                if new:
                    began, number = t, number + 1
                rounds.append(number)
                firsts.append(new)
            yield batch.drop(columns=["micros", "same"]).assign(round=rounds, first=firsts)[names]

    same = F.to_json(F.struct(*(F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(k) for k in keys))).alias("same")
    return rows.withColumn("same", same).repartition("same").sortWithinPartitions("same", "micros", "sequence").mapInPandas(fold, schema)


#: What ends the delivery of a trace.
LAST = ("done", "error")


def delivered(events: DataFrame, trace: str, sequence: str, kind: str, idle_seconds: int = 15) -> DataFrame:
    """events(trace, sequence, kind) as they may be sent: trace, sequence, kind in order of sequence from 0 without a gap, up to the first ``done`` or ``error``.

    Of events with the same sequence one counts (the first to arrive on a stream, the least kind on a batch). What follows a gap waits for what is missing, what follows the end is dropped.
    On a stream, a trace that waits for ``idle_seconds`` of the clock gets a row ``keepalive`` without a sequence.
    """
    rows = events.select(F.col(trace).alias("trace"), F.col(sequence).cast("long").alias("sequence"), F.col(kind).alias("kind"))
    if not rows.isStreaming:
        lone = rows.filter("trace is not null and sequence >= 0").groupBy("trace", "sequence").agg(F.min("kind").alias("kind"))
        by = Window.partitionBy("trace").orderBy("sequence")
        lone = lone.withColumn("_n", F.row_number().over(by)).filter("_n = sequence + 1")
        ended = F.max(F.col("kind").isin(*LAST).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
        return lone.withColumn("_ended", F.coalesce(ended, F.lit(0))).filter("_ended = 0").select("trace", "sequence", "kind")
    kinds = dict(rows.dtypes)
    schema = f"trace {kinds['trace']}, sequence long, kind string"
    place, number, held = (StructType.fromDDL(x) for x in ("sequence long, over boolean", "sequence long", "kind string"))

    class Delivery(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.next = handle.getValueState("next", place)
            self.waiting = handle.getMapState("waiting", number, held)

        def _again(self, timerValues) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * idle_seconds)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            at, over = self.next.get() if self.next.exists() else (0, False)
            out = []
            for r in pd.concat(list(rows)).itertuples(index=False):
                if not over and r.sequence >= at and not self.waiting.containsKey((int(r.sequence),)):
                    self.waiting.updateValue((int(r.sequence),), (r.kind,))
            while not over and self.waiting.containsKey((at,)):
                (one,) = self.waiting.getValue((at,))
                self.waiting.removeKey((at,))
                out.append((key[0], at, one))
                at, over = at + 1, one in LAST
            self.next.update((at, over))
            if over:
                self.waiting.clear()
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
            else:
                self._again(timerValues)
            yield pd.DataFrame(out, columns=["trace", "sequence", "kind"]).astype({"sequence": "Int64"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self._again(timerValues)
            yield pd.DataFrame([(key[0], None, "keepalive")], columns=["trace", "sequence", "kind"]).astype({"sequence": "Int64"})

        def close(self) -> None:
            pass

    return rows.groupBy("trace").transformWithStateInPandas(Delivery(), StructType.fromDDL(schema), "Append", "ProcessingTime")


def once(path: str):
    """A ``foreachBatch`` sink that writes each micro-batch to a folder of its own, so that one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
