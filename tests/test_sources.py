"""Sources and sinks on small files, and what no SQL states."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom import schema
from sparkloom.functions import vector
from sparkloom.operators import indexer, memory
from sparkloom.sources import files


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_queries_only(spark):
    df = spark.range(3)
    assert files.query(spark, "select id from few where id > ?", [1], few=df).count() == 1
    with pytest.raises(ValueError):
        files.query(spark, "drop table few")


def test_snapshot_replaces_what_its_plan_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_snapshot(spark.range(3).withColumn("tenant_id", F.lit("a")), path, "tenant_id")
    old = spark.read.parquet(path)
    files.write_snapshot(old.withColumn("id", F.col("id") + 10), path, "tenant_id")
    assert rows(spark.read.parquet(path), "id", "tenant_id") == [(10, "a"), (11, "a"), (12, "a")]


def test_analysis(spark, tmp_path):
    path = tmp_path / "analysis.json"
    assert files.read_analysis(spark, str(path)).count() == 0
    path.write_text(json.dumps({"graph": {"nodes": [{"id": "m", "label": "m", "type": "module", "line": 1}], "links": []}, "insights": [], "entityCounts": {"modules": 5}, "totalFilesAnalyzed": 42, "totalFilesSkipped": 3}))
    found = files.read_analysis(spark, str(path))
    nodes, links = files.analysis_parts(found)
    assert found.first()["totalFilesAnalyzed"] == 42 and nodes.count() == 1 and links.count() == 0
    files.write_analysis(nodes, links, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "nodes")).first()["id"] == "m"


def test_markdown_stays_where_it_is(spark, tmp_path):
    folder = str(tmp_path / "genes")
    made = lambda text: spark.createDataFrame([("one", text), ("two", text)], "name string, text string")
    files.write_markdown(made("a\nb").where("name = 'one'"), folder)
    files.write_markdown(made("c"), folder)
    found = spark.read.schema("text string, name string").text(folder, wholetext=True)
    assert [(n, t.strip()) for n, t in rows(found, "name", "text")] == [("one", "a\nb"), ("two", "c")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.md").write_text('---\nname: "x"\ndescription: "says x"\ncategory: pattern\n---\nbody')
    assert rows(files.markdown_genes(spark, str(tmp_path / "in")), "name", "description", "category") == [("x", "says x", "pattern")]


def test_session_files(spark, tmp_path):
    name = "01234567-89ab-cdef-0123-456789abcdef"
    for folder, body in ((tmp_path / "p", "x" * 200), (tmp_path / "p" / "subagents", "x" * 200)):
        folder.mkdir()
        (folder / f"{name}.jsonl").write_text(body)
    (tmp_path / "p" / "notes.jsonl").write_text("x" * 200)
    found = files.session_files(spark, str(tmp_path))
    assert rows(found, "session_id") == [(name,)]
    assert files.unprocessed(found, found).count() == 0 and files.unprocessed(found, found, force=True).count() == 1
    assert rows(files.session_lines(spark, found), "session_id", "n", "value") == [(name, 0, "x" * 200)]


def test_ignore_file(spark, tmp_path):
    (tmp_path / "ignore").write_text("# comment\n\n  build/ \n*.log\n")
    assert files.ignore_patterns(spark, str(tmp_path / "ignore")) == ["build/", "*.log"]


def test_tables_are_made_once(spark, tmp_path):
    assert set(schema.ensure_tables(spark, str(tmp_path))) == set(schema.TABLES)
    assert schema.ensure_tables(spark, str(tmp_path)) == []


def test_ingest(spark):
    turns = [(1, 1, "user", "The build fails with an error in the parser of the log files. I prefer short names in all modules of ours."), (1, 2, "assistant", "Remember that the weather was wrong in the report of yesterday."), (2, 1, "user", "hello")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    stored = schema.normalize(spark.createDataFrame([], "id string"), "memories").select("id", "session_id", "project", "memory_type", "content", "content_hash", "importance", "confidence", "evidence_count", "created_at", "tenant_id")
    once, counts = memory.ingest(stored, df, "t", "2024-03-01 00:00:00")
    assert tuple(counts.first()) == (3, 1, 2)
    assert rows(once, "memory_type", "evidence_count") == [("MISTAKE", 1), ("PREFERENCE", 1)]
    twice, _ = memory.ingest(once, df, "t", "2024-03-02 00:00:00")
    assert rows(twice, "memory_type", "evidence_count") == [("MISTAKE", 2), ("PREFERENCE", 2)]


def test_consolidation(spark):
    day = lambda n: datetime(2024, 1, n)
    made = [("a", 1, [1.0, 0.0], 0.5, 5, day(1)), ("b", 1, [1.0, 0.01], 0.9, 5, day(2)), ("c", 1, [0.0, 1.0], 0.5, 5, day(3)), ("d", 1, [-1.0, 0.1], 0.06, 2, day(4))]
    df = spark.createDataFrame(made, "id string, t int, embedding array<double>, confidence double, importance int, created_at timestamp")
    df = df.withColumns({"tenant_id": F.lit("t"), "project": F.lit("p"), "memory_type": F.lit("PATTERN"), "content": F.col("id"), "status": F.lit("active"), "evidence_count": F.lit(1), "access_count": F.lit(0), "last_accessed_at": F.lit(None).cast("timestamp")})
    done = memory.run_consolidation(df, "2024-03-01 00:00:00")
    assert rows(done.memories, "id") == [("a",), ("c",), ("d",)]  # b is as important as a, and later
    assert rows(done.concepts, "label", "evidence_count") == [("Pattern: PATTERN in p", 3)]
    first = done.concepts.first()
    assert first["confidence"] == pytest.approx(0.7 + 0.3 * (1 - 2.718281828**-0.6)) and len(first["embedding"]) == 64
    assert dict(rows(done.report, "step", "n")) == {"processed": 4, "skipped_vectors": 0, "duplicates_removed": 1, "concepts_made": 1, "concepts_raised": 1, "archived": 1, "superseded": 0}
    assert memory.run_consolidation(df.limit(0), "2024-03-01 00:00:00").memories.count() == 0


def test_consolidation_forms_no_pairs_of_a_dense_group(spark, monkeypatch):
    def settle(pairs):
        raise AssertionError("all similar pairs were formed")

    monkeypatch.setattr(memory, "settle_pairs", settle)
    df = spark.range(200).selectExpr("cast(id as string) id", "array(1D, id / 1000) embedding", "0.5D confidence", "cast(1 + id % 7 as int) importance", "timestamp_seconds(1704067200 + id) created_at")
    df = df.withColumns({"tenant_id": F.lit("t"), "project": F.lit("p"), "memory_type": F.lit("PATTERN"), "content": F.col("id"), "status": F.lit("active"), "evidence_count": F.lit(1), "access_count": F.lit(0), "last_accessed_at": F.lit(None).cast("timestamp")})
    done = memory.run_consolidation(df, "2024-03-01 00:00:00")
    assert rows(done.memories, "id") == [("6",)]  # the first of those that weigh most
    report = {r["step"]: (r["n"], r["error"]) for r in done.report.collect()}
    assert report["duplicates_removed"] == (199, None) and report["superseded"] == (0, None)


def test_a_step_that_fails_is_reported_and_the_others_run(spark):
    made = [("a", [1.0, 0.0], 0.5, datetime(2024, 1, 1)), ("b", [0.0, 1.0], 0.5, datetime(2024, 1, 2)), ("c", None, 0.5, datetime(2024, 1, 3))]
    df = spark.createDataFrame(made, "id string, embedding array<double>, confidence double, created_at timestamp")
    df = df.withColumns({"tenant_id": F.lit("t"), "project": F.lit("p"), "memory_type": F.lit("PATTERN"), "content": F.col("id"), "importance": F.lit(5), "status": F.lit("active"), "evidence_count": F.lit(1), "access_count": F.lit(0)})  # no last_accessed_at: scoring fails
    done = memory.run_consolidation(df, "2024-03-01 00:00:00", steps=("dedup", "no such step", *memory.STEPS[1:]))
    report = {r["step"]: (r["n"], r["error"]) for r in done.report.collect()}
    assert report["no such step"][0] is None and report["no such step"][1].startswith("KeyError")
    assert "last_accessed_at" in report["score_memories"][1] and "archived" not in report
    assert report["skipped_vectors"] == (1, None) and report["duplicates_removed"] == (0, None)
    assert done.memories.count() == 3 and rows(done.memories.where("superseded_by_id is not null"), "id") == []


def test_project_folders(spark):
    listing = [("/w/a", ".git", 1), ("/w/b", ".analysis", 2), ("/w/c", ".analysis/settings.json", 3), ("/w/.x/d", ".git", 4), ("/home/me", ".git", 5), ("/", ".git", 6), ("/w/ide", ".git", 7), ("/w/ide", "resources/app/out/vs/x", 7), ("/w/.analysis/e", ".git", 8), ("/w/..f", ".git", 9)]
    found = files.project_dirs(spark.createDataFrame(listing, "dir string, child string, modified_at long"), home="/home/me/")
    assert [r["dir"] for r in found.collect()] == ["/w/..f", "/w/.analysis/e", "/w/c", "/w/a"]


def test_extensions_in_any_case(spark, tmp_path):
    for name in ("A.TS", "b.Py", "c.txt", "d.rs"):
        (tmp_path / name).write_text("class Thing {}\n")
    code = files.source_tree(spark, str(tmp_path))
    nodes, _ = indexer.index(code)
    assert rows(nodes.where("type = 'module'"), "label", "color") == [("A.TS", "#3178c6"), ("b.Py", "#3776ab"), ("d.rs", "#dea584")]
    assert rows(nodes.where("type = 'class'"), "filePath", "label") == [("A.TS", "Thing"), ("b.Py", "Thing")]


def test_hashed_vectors_against_plain_python(spark):
    import xxhash

    texts = ["Some words, some more", "ÄÖ ä", "one", "  ", "a-b_c 7 seven"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vector.hashed(F.col("t"), 16).alias("v"))
    for text, v in (tuple(r) for r in df.collect()):
        counts = [0] * 16
        for word in filter(None, re.split(r"[\W_]+", text.lower())):
            h = xxhash.xxh64_intdigest(word.encode(), 42)
            counts[(h - (1 << 64) if h >> 63 else h) % 16] += 1
        length = sum(c * c for c in counts) ** 0.5
        assert v == (pytest.approx([c / length for c in counts]) if length else None)
