"""Streams with timers and typed state: agents that fall silent, and the whole course of tasks.

Both need the RocksDB state store (use_rocksdb) and run in event time or by
arrival; both forms, stream and batch, give the same rows once a stream has read
everything and its watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .state import STALE_S, STEPS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITIONS = "agent_id string, status string, at_ms long"
COURSE = "task_id string, steps long, state string, history array<string>, rejected long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _frame(**columns: list) -> pd.DataFrame:
    """Texts and lists as plain objects, which every version of Arrow takes."""
    return pd.DataFrame({c: pd.Series(v, dtype=object if c in ("agent_id", "status", "task_id", "state", "history") else "int64") for c, v in columns.items()})


class Silence(StatefulProcessor):
    """Emits online at an agent's first beat and at its first one after a silence, offline when a beat is overdue.

    State: the last beat, and whether offline has been said. A beat sets a timer;
    the watermark fires it if no later beat has set another.
    """

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last_ms long, offline boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        beats = sorted({int(x) for pdf in rows for x in pdf["ms"]})
        last, offline = self.state.get() if self.state.exists() else (None, True)
        out = []
        for beat in beats:
            if last is not None and beat <= last:
                continue  # late: a later beat is known
            if last is not None and not offline and beat > last + self.after_ms:
                out.append(("offline", last + self.after_ms))
                offline = True
            if offline:
                out.append(("online", beat))
            last, offline = beat, False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not offline:
            self.handle.registerTimer(last + self.after_ms)
        self.state.update((last, offline))
        yield _frame(agent_id=[key[0]] * len(out), status=[s for s, _ in out], at_ms=[m for _, m in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, offline = self.state.get()
        if not offline and expiredTimerInfo.getExpiryTimeInMs() >= last + self.after_ms:
            self.state.update((last, True))
            yield _frame(agent_id=[key[0]], status=["offline"], at_ms=[last + self.after_ms])

    def close(self) -> None:
        pass


def transitions_stream(beats: DataFrame, after_s: int = STALE_S, late: str = "0 seconds") -> DataFrame:
    """agent_id, status, at_ms of a stream of beats (agent_id, at), each once: when an agent came, fell silent and came back.

    Beats that are older than the latest of all by more than late when their batch
    comes are dropped, as is a batch's beat that is older than its agent's latest.
    Beats without an agent or a time are left out.
    """
    rows = beats.where("agent_id is not null and at is not null").select("agent_id", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    rows = rows.withColumn("ms", F.expr("unix_millis(at)"))
    return rows.groupBy("agent_id").transformWithStateInPandas(statefulProcessor=Silence(after_s * 1000), outputStructType=TRANSITIONS, outputMode="Append", timeMode="EventTime")


def transitions(beats: DataFrame, as_of, after_s: int = STALE_S) -> DataFrame:
    """The same over a table: a window over each agent's beats. An agent silent for longer than after_s at as_of is offline."""
    rows = beats.where("agent_id is not null and at is not null").select("agent_id", F.expr("unix_millis(cast(at as timestamp))").alias("ms")).distinct()
    order = Window.partitionBy("agent_id").orderBy("ms")
    rows = rows.withColumns({"before": F.lag("ms").over(order), "after": F.lead("ms").over(order)})
    limit, end = after_s * 1000, F.unix_millis(F.lit(as_of).cast("timestamp"))
    came = rows.where(F.col("before").isNull() | (F.col("ms") > F.col("before") + limit)).select("agent_id", F.lit("online").alias("status"), F.col("ms").alias("at_ms"))
    left = rows.where(F.coalesce(F.col("after"), end) > F.col("ms") + limit).select("agent_id", F.lit("offline").alias("status"), (F.col("ms") + limit).alias("at_ms"))
    return came.unionByName(left)


class Course(StatefulProcessor):
    """Keeps a task's state and, as a list, all of its accepted steps; steps that may not follow are counted."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, rejected long", self.ttl_ms)
        self.history = handle.getListState("history", "step string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, rejected = self.now.get() if self.now.exists() else (None, 0)
        events = pd.concat(list(rows)).sort_values(["ms", "seq"])
        for to, note in zip(events["to"], events["note"]):
            if (state is None and to == "created") or (state is not None and to in STEPS[state]):
                state = to
                self.history.appendValue((f"{to}: {note}" if note else to,))
            else:
                rejected += 1
        self.now.update((state, rejected))
        steps = [s for (s,) in self.history.get()] if self.history.exists() else []
        yield _frame(task_id=[key[0]], steps=[len(steps)], state=[state], history=[steps], rejected=[rejected])

    def close(self) -> None:
        pass


def courses_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """task_id, steps, state, history, rejected of each task that a batch of events (task_id, at, seq, to, note) touches, after it.

    The history is the whole of it, whatever batches it came in; the last row of a
    task is what state.task_states gives for all events at once. With ttl_ms a task
    that nothing happens to for so long is forgotten; the clock then drives the
    stream, which doesn't end by itself.
    """
    rows = events.where("task_id is not null").select("task_id", F.expr("unix_millis(cast(at as timestamp))").alias("ms"), "seq", "to", F.coalesce("note", F.lit("")).alias("note"))
    return rows.groupBy("task_id").transformWithStateInPandas(statefulProcessor=Course(ttl_ms), outputStructType=COURSE, outputMode="Update", timeMode="None" if ttl_ms is None else "ProcessingTime")


