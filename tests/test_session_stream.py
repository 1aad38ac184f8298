"""Appended lines of session logs, over restarts."""

import json

from sparkloom.sources import files, session_stream

A, B = "01234567-89ab-cdef-0123-456789abcdef", "11234567-89ab-cdef-0123-456789abcdef"
said = lambda who, text: json.dumps({"type": who, "message": json.dumps({"content": text})})


def test_lines_come_once(spark, tmp_path):
    logs = tmp_path / "logs" / "p"
    (logs / "subagents").mkdir(parents=True)
    session_stream.register(spark)

    def run():
        df = spark.readStream.format("session_logs").option("path", str(tmp_path / "logs")).load()
        save = lambda rows, number: rows.write.mode("append").parquet(f"{tmp_path}/out/run")
        df.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["session_id"], r["n"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out/run").collect())

    lines = [said("user", f"please look at number {i} of these files") for i in range(6)]
    first = "\n".join(lines[:2]) + "\n\n"
    (logs / f"{A}.jsonl").write_text(first + lines[2][:20])  # the third line isn't whole yet
    (logs / "subagents" / f"{A}.jsonl").write_text("x\n" * 200)
    (logs / f"{B}.jsonl").write_text("short\n")
    (logs / "notes.jsonl").write_text("x\n" * 200)
    expected = [(A, 0, lines[0]), (A, len(lines[0]) + 1, lines[1])]
    assert run() == expected
    assert run() == expected  # nothing new
    with (logs / f"{A}.jsonl").open("a") as log:
        log.write(lines[2][20:] + "\n" + lines[3] + "\n")
    (logs / f"{B}.jsonl").write_text("short\n" + lines[4] + "\n" + "é" * 100 + "\n")
    expected += [(A, len(first), lines[2]), (A, len(first) + len(lines[2]) + 1, lines[3]), (B, 0, "short"), (B, 6, lines[4]), (B, 7 + len(lines[4]), "é" * 100)]
    assert run() == expected
    texts = files.session_transcripts(spark.createDataFrame(expected, session_stream.SCHEMA))
    assert {r["session_id"] for r in texts.collect()} == {A, B}


def test_the_end_of_a_line_is_found_from_behind(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(session_stream, "TAIL", 4)
    data = b"abc\ndefghijklmnop"
    source = pa.BufferReader(data)
    assert session_stream.end_of_lines(source, 0, len(data)) == 4
    assert session_stream.end_of_lines(source, 4, len(data)) == 4 and session_stream.end_of_lines(source, 0, 4) == 4
