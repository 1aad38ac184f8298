"""Streams with timers against their batch forms, with a restart in between."""

from datetime import datetime, timedelta

import pytest

from sparkloom.streaming import state, timers

START = datetime(2024, 3, 1)
BEATS = "agent_id string, at timestamp"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    timers.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _run(df, folder, mode):
    """Each batch goes to a folder of its number; what is read is remembered below check."""
    save = lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/out/n={number}")
    df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()


def _beats(*pairs):
    return [(a, START + timedelta(seconds=s)) for a, s in pairs]


def test_silence(spark, tmp_path):
    first = _beats(("a", 0), ("a", 100), ("a", 220), ("b", 10), (None, 5), ("c", 0), ("c", 121))
    second = _beats(("a", 341), ("d", 400), ("a", 330))
    too_late = _beats(("b", 129))  # the watermark is at 220 when it comes, and b has been found silent
    third = _beats(("clock", 2_000))
    source = str(tmp_path / "in")
    stream = lambda: timers.transitions_stream(spark.readStream.schema(BEATS).parquet(source))
    for batch in (first, second + too_late, third):
        spark.createDataFrame(batch, BEATS).coalesce(1).write.mode("append").parquet(source)
        _run(stream(), tmp_path, "append")  # each is a restart from the checkpoint
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").drop("n").collect() if r[0] != "clock")
    expected = timers.transitions(spark.createDataFrame(first + second, BEATS), START + timedelta(seconds=2_000))
    assert got == sorted(tuple(r) for r in expected.collect())
    ms = lambda s: int((START + timedelta(seconds=s)).timestamp() * 1000) - int(START.timestamp() * 1000)
    base = min(r[2] for r in got)
    assert [(s, m - base) for a, s, m in got if a == "a"] == [("offline", ms(461)), ("online", 0)]
    assert [(s, m - base) for a, s, m in sorted(got, key=lambda r: r[2]) if a == "c"] == [("online", 0), ("offline", 120_000), ("online", 121_000), ("offline", 241_000)]


EVENTS = "task_id string, tenant_id string, at timestamp, seq long, to string, note string"


def test_courses_keep_the_whole_history(spark, tmp_path):
    steps = [("created", None), ("assigned", "to x"), ("approved", None), ("implemented", ""), ("fixes_needed", "again"), ("implemented", None), ("approved", "good"), ("created", None)]
    events = [("t1", "t", START + timedelta(minutes=i), i, to, note) for i, (to, note) in enumerate(steps)] + [("t2", "t", START, 0, "assigned", None), ("t3", "t", START, 0, "created", None)]
    source = str(tmp_path / "in")
    for batch in (events[:3], events[3:6] + events[8:], events[6:8]):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(source)
        _run(timers.courses_stream(spark.readStream.schema(EVENTS).parquet(source)), tmp_path, "update")
    whole = {r["task_id"]: (r["state"], r["history"], r["rejected"], len(r["history"])) for r in state.task_states(spark.createDataFrame(events, EVENTS)).collect()}
    out = spark.read.option("basePath", f"{tmp_path}/out").parquet(*sorted(str(p) for p in (tmp_path / "out").iterdir()))
    last = {r["task_id"]: (r["state"], r["history"], r["rejected"], r["steps"]) for r in out.orderBy("n").collect()}
    assert last == whole and last["t1"][3] == 6
