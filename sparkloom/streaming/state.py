"""State over time: limits, heartbeats, task states, schedules; batch and streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, WINDOW_MS, IDLE_MS = 60, 60_000, 300_000
STALE_S = 120


def accept(times: list[int], kept: list[int], limit: int, window_ms: int) -> tuple[list[bool], list[int]]:
    """Which of the times (sorted, milliseconds) pass a sliding window, and the accepted times that still count."""
    out = []
    for t in times:
        while kept and t - kept[0] >= window_ms:
            kept.pop(0)
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


def rate_limit(events: DataFrame, key: str = "user_id", at: str = "ts", ordinal: str = "event_id", limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """(key, ordinal, accepted) of each event. A key's events are a sequence, as refused ones don't count against later ones.

    Rows come sorted from the shuffle and are read in batches, so that a key of
    any length takes the memory of the times that still count.
    """
    kinds = dict(events.dtypes)
    millis = F.expr(f"cast(floor(unix_micros(cast(`{at}` as timestamp)) / 1000) as bigint)")
    rows = events.select(key, ordinal, millis.alias("_ms")).repartition(key).sortWithinPartitions(key, "_ms", ordinal)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, []
        for pdf in batches:
            marks = []
            for k, part in pdf.groupby(key, sort=False, dropna=False):
                if k != last:
                    last, kept = k, []
                found, kept = accept(part["_ms"].tolist(), kept, limit, window_ms)
                marks += found
            yield pd.DataFrame({key: pdf[key], ordinal: pdf[ordinal], "accepted": marks})

    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, `{ordinal}` {kinds[ordinal]}, accepted boolean")


def rate_limit_stream(events: DataFrame, key: str = "user_id", at: str = "ts", ordinal: str = "event_id", limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """The same over a stream, in event time; a key's state goes after five idle minutes, and events later than that are dropped.

    Timeouts by the wall clock would keep a query that reads what is available from ever ending.
    """
    kinds = dict(events.dtypes)

    def run(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values(["_ms", ordinal])
        kept = list(state.get[0]) if state.exists else []
        marks, kept = accept(pdf["_ms"].tolist(), kept, limit, window_ms)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int(pdf["_ms"].max()) + IDLE_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], ordinal: pdf[ordinal], "accepted": marks})

    rows = events.select(key, ordinal, F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", f"{IDLE_MS} milliseconds")
    rows = rows.withColumn("_ms", F.expr("cast(floor(unix_micros(_at) / 1000) as bigint)"))
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{ordinal}` {kinds[ordinal]}, accepted boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_heartbeats(beats: DataFrame, key: str = "agent_id", at: str = "at") -> DataFrame:
    """Each agent's first and last beat; unknown ones are registered by their first. Works on streams as well (complete or update mode)."""
    return beats.groupBy(key).agg(F.min(at).alias("registered_at"), F.max(at).alias("last_heartbeat"))


def with_staleness(agents: DataFrame, as_of, at: str = "last_heartbeat", after_s: int = STALE_S) -> DataFrame:
    """status offline where the last beat is more than after_s seconds ago, else online."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return agents.withColumn("status", F.when(F.col(at).isNull() | (age > after_s * 1_000_000), "offline").otherwise("online"))


# The task states that may follow a state.
STEPS = {"created": ("assigned",), "assigned": ("implemented",), "implemented": ("fixes_needed", "approved"), "fixes_needed": ("implemented",), "approved": ()}


def task_states(events: DataFrame) -> DataFrame:
    """(task_id, tenant_id, state, history, rejected) after the events (task_id, tenant_id, at, seq, to, note) of each task, in order; steps that may not follow are counted as rejected."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, history, rejected = None, [], 0
        for to, note in pdf.sort_values(["at", "seq"])[["to", "note"]].itertuples(index=False):
            if (state is None and to == "created") or (state is not None and to in STEPS[state]):
                state = to
                history.append(f"{to}: {note}" if note else to)
            else:
                rejected += 1
        return pd.DataFrame({"task_id": [key[0]], "tenant_id": [key[1]], "state": [state], "history": [history], "rejected": [rejected]})

    return events.groupBy("task_id", "tenant_id").applyInPandas(run, "task_id string, tenant_id string, state string, history array<string>, rejected long")


def task_states_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: a row for each task and batch that touched it."""

    def run(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, rejected = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(pdfs)).sort_values(["at", "seq"])
        for to in pdf["to"]:
            if (now is None and to == "created") or (now is not None and to in STEPS[now]):
                now = to
            else:
                rejected += 1
        state.update((now, rejected))
        yield pd.DataFrame({"task_id": [group[0]], "state": [now], "rejected": [rejected]})

    return events.groupBy("task_id").applyInPandasWithState(run, "task_id string, state string, rejected long", "state string, rejected long", "update", GroupStateTimeout.NoTimeout)


def cron_matches(at: Column, pattern: str) -> Column:
    """Whether a moment meets minute hour day month weekday, each * or a number (weekdays from 0, Sunday)."""
    values = (F.minute(at), F.hour(at), F.dayofmonth(at), F.month(at), F.dayofweek(at) - 1)
    out = F.lit(True)
    for field, value in zip(pattern.split(), values, strict=True):
        if field != "*":
            out = out & (value == int(field))
    return out


def cron_runs(minutes: DataFrame, pattern: str, at: str = "at") -> DataFrame:
    """The first matching minute of each day."""
    return minutes.where(cron_matches(F.col(at), pattern)).groupBy(F.to_date(at).alias("day")).agg(F.min(at).alias("run_at"))


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event-time sessions by key; on a stream late events are waited for."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def ingest_batches(stream: DataFrame, save, checkpoint: str):
    """Starts a query that hands each batch of transcripts to save(batch, number) and ends when all input is read."""
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()



def running_count(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds n: how many rows of the key there were so far."""
    return df.withColumn("n", F.count("*").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
