"""Operators on literal rows, with values worked out by hand."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom.functions import text, vector
from sparkloom.operators import filters, genes, graph, indexer, memory, scanner, transcripts
from sparkloom.sources import files
from sparkloom.streaming import state

NOW = datetime(2024, 3, 1)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_initial_confidence(spark):
    df = spark.createDataFrame([("MISTAKE", 9), ("KNOWLEDGE", 3), ("SESSION_SUMMARY", 7)], "t string, i int")
    got = [r[0] for r in df.select(memory.initial_confidence(F.col("t"), F.col("i"))).collect()]
    assert got == pytest.approx([0.90, 0.35, 0.65])


def test_rerank_score(spark):
    df = spark.createDataFrame([(0.9, 0.5, 1, None, NOW, 5), (0.3, 0.7, 3, "auth/login", NOW - timedelta(days=120), 8)], "b double, confidence double, evidence_count long, scope string, created_at timestamp, importance int")
    got = [r[0] for r in df.select(memory.rerank_score(F.col("b"), F.lit(NOW), "auth")).collect()]
    assert got == pytest.approx([1.21, 0.69])


def test_lifecycle(spark):
    day = timedelta(days=1)
    df = spark.createDataFrame(
        [(1, 0.5, NOW - 20 * day, NOW - 10.5 * day, 0, 0, "active"), (2, 0.5, NOW - 0.5 * day, None, 3, 0, None), (3, 0.5, NOW, None, 0, 7, "active"), (4, 0.05, NOW - 400 * day, None, 1, 0, "active"), (5, 0.5, NOW - 400 * day, None, 50, 50, "superseded")],
        "id long, confidence double, created_at timestamp, last_accessed_at timestamp, evidence_count long, access_count long, status string",
    )
    got = {r["id"]: (r["confidence"], r["status"]) for r in memory.lifecycle(df, "2024-03-01 00:00:00").collect()}
    assert got[1] == (pytest.approx(0.5 * 0.995**10), "active")
    assert got[2] == (pytest.approx(0.60), "active")
    assert got[3] == (pytest.approx(0.56), "active")
    assert got[4] == (pytest.approx(0.05), "archived")
    assert got[5] == (pytest.approx(0.5), "superseded")


def test_concept_confidence(spark):
    got = spark.range(1).select(memory.concept_confidence(F.lit(0.7), F.lit(2)), memory.concept_confidence(F.lit(0.99), F.lit(2))).first()
    assert got[0] == pytest.approx(0.798904, abs=1e-6) and got[1] == 0.99


def test_noise_gate(spark):
    rows = [("short", "KNOWLEDGE", 5, "too short"), ("x" * 39, "KNOWLEDGE", 5, "too short"), ("word " * 8, "KNOWLEDGE", 5, "too short"), ("functional " * 4, "KNOWLEDGE", 5, None), ("y" * 2001, "PATTERN", 5, "too long"), ("y" * 2001, "SESSION_SUMMARY", 5, None), ("z" * 50, "MISTAKE", 2, "importance"), ("the and of to in it is was are been being have", "PATTERN", 5, "stop words"), ("remember that the weather matters when deploying servers", "KNOWLEDGE", 5, "blocklist: weather note"), ("  ", "FEEDBACK", 5, "empty"), (None, "FEEDBACK", 5, "empty")]
    df = spark.createDataFrame([r[:3] for r in rows], "c string, t string, i int")
    assert [r[0] for r in df.select(text.noise_reason(F.col("c"), F.col("t"), F.col("i"))).collect()] == [r[3] for r in rows]


@pytest.mark.parametrize("sample", ["an english lesson today", "the new lesson", "when to use raining", "tính danh là gì", "học tiếng anh nhé", "how to pronounce it", "sunny day", "my shopping list", "buy bananas", "plain yogurt", "miss breakfast", "retry the failed job", "interview question", "tic tac toe", "same input x repeated multiple times"])
def test_blocklist(spark, sample):
    assert spark.range(1).select(text.blocklist_reason(F.lit(sample))).first()[0]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_vector_bytes(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select("v", vector.from_bytes(vector.to_bytes("v")).alias("w"))
    assert all(r["v"] == r["w"] for r in df.collect())


def _vectors(spark, rows):
    return spark.createDataFrame([(i, "t", "p", "m", float(imp), c, datetime(2024, 1, d), v) for i, imp, c, d, v in rows], "id string, tenant_id string, project string, memory_type string, importance double, confidence double, created_at timestamp, embedding array<float>")


def test_greedy_duplicates(spark):
    a, b, far = [1.0, 0.0], [0.99, 0.1], [0.0, 1.0]
    df = _vectors(spark, [("a", 5, 0.5, 1, a), ("b", 5, 0.5, 2, b), ("c", 9, 0.5, 3, a), ("d", 1, 0.5, 4, far), ("e", 1, 0.5, 5, [0.0, 0.0])])
    assert {r[0] for r in memory.greedy_duplicates(df).collect()} == {"a", "b"}


def test_greedy_duplicates_is_idempotent(spark):
    df = _vectors(spark, [(f"v{i}", i % 3, 0.5, 1 + i, [1.0, i / 20]) for i in range(12)])
    kept = df.join(memory.greedy_duplicates(df), "id", "left_anti")
    assert memory.greedy_duplicates(kept).count() == 0


def _greedy(rows, threshold):
    """ids that a plain walk over (id, tenant, importance, at, vector) removes."""
    import numpy as np

    rows = sorted((r for r in rows if r[1] is not None and r[4] is not None and any(r[4])), key=lambda r: (r[3], r[0]))
    unit = [np.float32(r[4]).astype(float) / np.linalg.norm(np.float32(r[4]).astype(float)) for r in rows]
    gone = set()
    for x, a in enumerate(rows):
        for y in range(x + 1, len(rows)):
            b = rows[y]
            if a[0] in gone:
                break
            if b[0] not in gone and a[1] == b[1] and len(a[4]) == len(b[4]) and unit[x] @ unit[y] > threshold:
                gone.add(a[0] if a[2] is not None and b[2] is not None and a[2] < b[2] else b[0])
    return gone


def test_greedy_duplicates_forms_few_of_all_pairs(spark, monkeypatch):
    import numpy as np

    from sparkloom.operators import rounds

    r = np.random.default_rng(5)
    rows = [(f"k{i:04}", f"t{i % 3}", None if i % 31 == 0 else float(r.integers(1, 6)), datetime(2024, 1, 1) + timedelta(hours=i // 2), [float(x) for x in r.normal(size=3 if i % 41 == 0 else 5)]) for i in range(450)]
    rows += [("n0", None, 1.0, NOW, rows[0][4]), ("n1", "t0", 1.0, NOW, None), ("n2", "t0", 1.0, NOW, []), ("n3", "t0", 1.0, NOW, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id string, tenant_id string, importance double, created_at timestamp, embedding array<float>").repartition(3)
    want = _greedy(rows, 0.5)

    def settle(pairs):
        raise AssertionError("all similar pairs were formed")

    monkeypatch.setattr(memory, "settle_pairs", settle)
    assert sorted(x[0] for x in memory.greedy_duplicates(df, 0.5, ["tenant_id"]).collect()) == sorted(want)
    for name, value in {"TURNS": 32, "PLACES": 3, "LATER": 50}.items():
        monkeypatch.setattr(memory, name, value)
    monkeypatch.setattr(rounds, "TOGETHER", 100)
    assert sorted(x[0] for x in memory.greedy_duplicates(df, 0.5, ["tenant_id"]).collect()) == sorted(want)


def test_greedy_duplicates_where_few_are_alike_and_without_a_group(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(6)
    rows = [(f"k{i:04}", "t", float(r.integers(1, 6)), datetime(2024, 1, 1) + timedelta(hours=i), [float(x) for x in r.normal(size=12)]) for i in range(240)]
    df = spark.createDataFrame(rows, "id string, tenant_id string, importance double, created_at timestamp, embedding array<float>")
    for name, value in {"TURNS": 16, "PLACES": 3, "LATER": 50}.items():
        monkeypatch.setattr(memory, name, value)
    calls, settle = [], memory.settle_pairs
    monkeypatch.setattr(memory, "settle_pairs", lambda pairs: calls.append(1) or settle(pairs))
    assert sorted(x[0] for x in memory.greedy_duplicates(df, 0.6, []).collect()) == sorted(_greedy(rows, 0.6))
    assert calls == [1]


def test_superseded(spark):
    df = _vectors(spark, [("a", 5, 0.3, 1, [1.0, 0.0]), ("b", 5, 0.6, 2, [1.0, 0.01]), ("c", 5, 0.3, 3, [1.0, 0.0])]).withColumn("status", F.lit(None).cast("string"))
    assert values(memory.superseded_ids(df), "id", "superseded_by") == [("a", "b")]


def test_similar_pairs_match_all_pairs(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(60, 8))
    df = _vectors(spark, [(f"{i:02}", 1, 0.5, 1 + i % 28, [float(x) for x in row]) for i, row in enumerate(v)])
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = {frozenset((f"{i:02}", f"{j:02}")) for i in range(60) for j in range(i) if u[i] @ u[j] > 0.6}
    assert {frozenset((r["earlier"], r["later"])) for r in memory.similar_pairs(df, ["project"], ["created_at"], 0.6).collect()} == want


def test_the_length_of_a_vector_is_computed_once(spark, monkeypatch):
    from sparkloom.operators import lsh

    plans, cut = [], memory.cut
    for module in (memory, lsh):
        monkeypatch.setattr(module, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    df = _vectors(spark, [("a", 5, 0.5, 1, [3.0, 4.0]), ("b", 5, 0.5, 2, [0.0, 0.0]), ("c", 5, 0.5, 3, [6.0, 8.0]), ("d", 5, 0.5, 4, []), ("e", 5, 0.5, 5, None), ("f", 5, 0.5, 6, [-1.0, 0.0])])
    for pairs in (memory.similar_pairs, lsh.similar_pairs_hashed):
        assert [(*x[:2], pytest.approx(1)) for x in values(pairs(df, ["project"], ["created_at"], 0.9), "earlier", "later", "similarity")] == [("a", "c", 1)]
    assert values(memory.greedy_duplicates(df, 0.9, ["project"]), "id") == [("c",)]
    counts = [p.count("aggregate(") for p in plans]
    assert max(counts) == 1 and sum(counts) == 3


def test_upsert_merge(spark):
    schema = "project string, memory_type string, content_hash string, tenant_id string, id string, importance double, confidence double, evidence_count long, scope string, created_at long"
    old = spark.createDataFrame([("p", "K", "h", "t", "old", 3.0, 0.9, 2, "auth", 1), ("p", "K", "g", "t", "other", 1.0, 0.1, 1, None, 1)], schema)
    new = spark.createDataFrame([("p", "K", "h", "t", "n1", 8.0, 0.2, 1, None, 5), ("p", "K", "h", "t", "n2", 2.0, 0.3, 1, None, 6)], schema)
    got = {r["content_hash"]: r for r in memory.upsert_merge(old, new).collect()}
    assert got["h"].asDict() | {"x": 0} == {"project": "p", "memory_type": "K", "content_hash": "h", "tenant_id": "t", "id": "n2", "importance": 8.0, "confidence": 0.9, "evidence_count": 4, "scope": "auth", "created_at": 1, "x": 0}
    assert got["g"]["id"] == "other"


def test_filters_and_tenants(spark):
    df = spark.createDataFrame([("a", "t1", "auth/login", ["jwt"], "KNOWLEDGE", "active"), ("b", "t1", "authx", ["sql"], "PREFERENCE", "archived"), ("c", "t2", "auth", ["jwt"], "KNOWLEDGE", None)], "id string, tenant_id string, scope string, tags array<string>, memory_type string, status string")
    assert values(filters.memory_filters(filters.scoped(df, "t1"), scope="auth", tags=["jwt"], types="knowledge,session_summary"), "id") == [("a",)]
    assert filters.scoped(df, None).count() == 0
    assert {x[0] for x in values(filters.memory_filters(df), "id")} == {"a", "c"}


def test_delete_counts(spark):
    df = spark.createDataFrame([("a", "t1"), ("b", "t2")], "id string, tenant_id string")
    assert values(memory.delete_ids(df, spark.createDataFrame([("a",), ("b",)], "id string"), "t1"), "id") == [("b",)]


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, "call", "p", "t", n) for n, (a, b) in enumerate(pairs)], "source_id string, target_id string, relationship_type string, project_name string, tenant_id string, ordinal int")


def test_cycles(spark):
    six = [f"s{i}" for i in range(6)]
    five = [f"f{i}" for i in range(5)]
    ring = lambda x: list(zip(x, x[1:] + x[:1]))
    e = _edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("d", "d"), *ring(five), *ring(six)])
    assert {r[0] for r in graph.on_cycles(e).collect()} == {"a", "b", "d", *five}


@pytest.mark.parametrize("depth,want", [(0, {"c"}), (1, {"b", "c", "d"}), (2, set("abcde")), (3, set("abcde"))])
def test_bfs(spark, depth, want):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    assert {r["id"] for r in graph.bfs(e, spark.createDataFrame([("c",)], "id string"), depth).collect()} == want


def test_back_edges(spark):
    e = _edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "b")])
    assert values(graph.back_edges(e), "project_name", "circular") == [("p", 2)]


def test_call_order(spark):
    nodes = spark.createDataFrame([("p", x, n) for n, x in enumerate("abcxy")], "project_name string, id string, ordinal int")
    got = graph.call_order(nodes, _edges(spark, [("a", "c"), ("b", "c"), ("x", "y"), ("y", "x")])).orderBy("position").collect()
    assert [r["id"] for r in got] == list("abcxy") and [r["ordered"] for r in got] == [True, True, True, False, False]


def test_dead_code_and_hubs(spark):
    entities = spark.createDataFrame([("e1", "fn1", "function", "a.ts", "t"), ("e2", "fn2", "function", "b.ts", "t")], "id string, entity_name string, entity_type string, file_path string, tenant_id string")
    e = _edges(spark, [("e1", "e2")])
    assert values(graph.dead_code(entities, e), "entity_name") == [("fn1",)]
    assert values(graph.god_objects(entities, e, more_than=0), "entity_name", "in_degree") == [("fn2", 1)]


def test_scanner(spark):
    nodes = spark.createDataFrame(
        [("1", "variable", "AWS_SECRET_KEY", "src/a.ts", 1), ("2", "function", "eval", "src/a.ts", 2), ("3", "function", "executeQuery", "src/db.ts", 3), ("4", "variable", "tokenCount", "src/a.ts", 4), ("5", "variable", "apiKey", "src/a.test.ts", 5), ("6", "function", "runQuery", "src/a.ts", 6), ("7", "function", "pool", "x.ts", 7), ("8", "variable", "key", None, 8)],
        "id string, type string, label string, filePath string, line int",
    )
    links = spark.createDataFrame([("6", "7")], "source string, target string")
    assert sorted(values(scanner.findings(nodes, links), "id", "type", "severity")) == [("1", "HARDCODED_SECRET", "HIGH"), ("2", "UNSAFE_FUNCTION", "CRITICAL"), ("3", "SQL_INJECTION_RISK", "MEDIUM"), ("6", "SQL_INJECTION_RISK", "MEDIUM")]


def test_identifier_words(spark):
    df = spark.createDataFrame([("HTTPServerName",), ("api_key",), ("kebab-case.x",)], "n string")
    assert [r[0] for r in df.select(text.identifier_words(F.col("n"))).collect()] == [["http", "server", "name"], ["api", "key"], ["kebab", "case", "x"]]


def test_indexer(spark):
    code = spark.createDataFrame([("src/a/m.ts", "import { x } from '../b'\nimport y from 'react'\nexport class C {}\nasync function go() { if (x) run(1) }"), ("p.py", "from .q import z\nclass K:\n  def __init__(self): pass\n  def f(self): pass"), ("g.go", "func Run() {}\nfunc hid() {}\ntype S struct {"), ("h.php", "abstract CLASS P {\n public function q() {}")], "path string, content string")
    nodes, links = indexer.index(code)
    assert {(r["type"], r["label"], r["line"]) for r in nodes.collect() if r["type"] != "module"} == {("class", "C", 3), ("function", "go", 4), ("class", "K", 2), ("function", "f", 4), ("function", "Run", 1), ("class", "S", 3), ("class", "P", 1), ("function", "q", 2)}
    got = {(r["source"], r["target"], r["type"]) for r in links.collect()}
    assert ("module:src/a/m.ts", "module:src/b.ts", "import") in got and ("module:p.py", "module:q.ts", "import") not in got
    assert ("module:src/a/m.ts", "function:module:src/a/m.ts:go", "call") in got and ("module:src/a/m.ts", "function:module:src/a/m.ts:run", "call") in got


def test_transcripts(spark):
    said = "[USER]\nI would prefer that tests run before every merge here. short.\n\n---\n\n[ASSISTANT]\nThe build has a critical bug in the parser that loses data! You should always keep the lock file beside the manifest.\n\n---\n\n[SYSTEM]\nThere is a bug here that nobody should ever see in results"
    got = transcripts.classify(spark.createDataFrame([(1, said)], "conv_id long, transcript string"))
    assert [(r["memory_type"], r["importance"]) for r in got.orderBy("rank").collect()] == [("MISTAKE", 8), ("PREFERENCE", 6), ("PATTERN", 6)]


def _gene(spark, *rows):
    return spark.createDataFrame([Row(id=f"g{n}", name=f"n{n}", project="p", tenant_id="t", problem="x", solution=s, confidence=c, usage_count=u, success_rate=0.5, version=1, status="active") for n, (s, c, u) in enumerate(rows)])


def test_mutate(spark):
    df = _gene(spark, ("", 0.7, 2), ("", 0.7, 2), ("", 0.7, 0))
    out = genes.mutate(df, spark.createDataFrame([("g0", "success"), ("g1", "failure")], "id string, outcome string"))
    got = {r["id"]: (r["confidence"], r["success_rate"], r["version"]) for r in out.collect()}
    assert got["g0"] == (pytest.approx(0.8), pytest.approx(2 / 3), 2) and got["g1"] == (pytest.approx(0.595), pytest.approx(1 / 3), 2) and got["g2"] == (0.7, 0.5, 1)


def test_split(spark):
    made, links = genes.split_genes(_gene(spark, ("1\n2\n3\n4\n5", 0.5, 0), ("", 0.5, 0)), ["a", "b"])
    got = {(r["name"], r["solution"]) for r in made.collect()}
    assert got == {("a", "1\n2"), ("b", "3\n4\n5"), ("a", "Split from n1"), ("b", "Split from n1")} and links.count() == 4
    with pytest.raises(ValueError):
        genes.split_genes(_gene(spark, ("1", 0.5, 0)), [str(i) for i in range(21)])


def test_merge_needs_two(spark):
    df = _gene(spark, ("a", 0.4, 0), ("b", 0.6, 0))
    made, merged, links = genes.merge_genes(df, df.select("id"), "m")
    assert made.first()["confidence"] == pytest.approx(0.5) and made.first()["solution"] == "a\n\nb" and links.count() == 2 and {r["status"] for r in merged.collect()} == {"merged"}
    assert genes.merge_genes(df, df.select("id").limit(1), "m")[0].count() == 0


def test_rate_limit(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, n, start + timedelta(milliseconds=10 * n)) for n in range(61)] + [(1, 61, start + timedelta(milliseconds=60_001))]
    got = {r["event_id"]: r["accepted"] for r in state.rate_limit(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")).collect()}
    assert sum(got.values()) == 61 and not got[60] and got[61]


def test_staleness(spark):
    df = spark.createDataFrame([(s, NOW - timedelta(seconds=s)) for s in (119, 120, 121)], "s int, last_heartbeat timestamp")
    assert dict(values(state.with_staleness(df, "2024-03-01 00:00:00"), "s", "status")) == {119: "online", 120: "online", 121: "offline"}


def test_tasks(spark):
    steps = ["created", "assigned", "approved", "implemented", "fixes_needed", "implemented", "approved", "assigned"]
    got = state.task_states(spark.createDataFrame([("x", "t", NOW, n, s, "") for n, s in enumerate(steps)], "task_id string, tenant_id string, at timestamp, seq int, to string, note string")).first()
    assert got["state"] == "approved" and got["rejected"] == 2 and got["history"] == ["created", "assigned", "implemented", "fixes_needed", "implemented", "approved"]


@pytest.mark.parametrize("pattern,path,want", [("/build", "build/x.ts", True), ("/build", "src/build/x.ts", False), ("*.log", "a/b.log", True), ("tmp/", "a/tmp/b.ts", True), ("tmp/", "a/tmp.ts", False), ("!keep", "keep", False), ("docs/**/x.ts", "docs/a/b/x.ts", True), ("name", "a/name/b.ts", True), ("a?c", "abc", True)])
def test_ignore(spark, pattern, path, want):
    assert spark.range(1).select(files.ignored(F.lit(path), [pattern])).first()[0] is want


def test_source_tree(spark, tmp_path):
    for name, body in {"a.ts": "function f() {}", "node_modules/x.ts": "x", "empty.py": "", "skip/b.py": "y", "n.txt": "z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    assert values(files.source_tree(spark, str(tmp_path), ["skip/"]), "path") == [("a.ts",)]


def test_session_log(spark):
    lines = [(0, '{"type":"user","message":{"content":"please look at the failing build today"}}'), (1, "{oops"), (2, '{"type":"assistant","message":{"content":[{"type":"text","text":"the build fails for want of a key"},{"type":"tool_use"}]}}'), (3, '{"type":"user","isMeta":true,"message":{"content":"meta text of more than twenty"}}'), (4, '{"type":"user","message":{"content":"short"}}')]
    df = spark.createDataFrame([("s", n, v) for n, v in lines], "session_id string, n long, value string")
    assert files.session_transcripts(df).first()["transcript"] == "[USER]\nplease look at the failing build today\n\n---\n\n[ASSISTANT]\nthe build fails for want of a key"


def test_schema_defaults(spark):
    from sparkloom.schema import normalize, schema

    out = normalize(spark.createDataFrame([("a", None)], "ID string, status string"), "memories")
    assert out.columns == schema("memories").fieldNames() and out.first()["status"] == "active" and out.first()["version"] == 1


def test_streaming_limit(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, n, start + timedelta(seconds=n)) for n in range(5)], "user_id long, event_id long, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = state.rate_limit_stream(stream, limit=3).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert sorted(values(spark.table("limited"), "event_id", "accepted")) == [(0, True), (1, True), (2, True), (3, False), (4, False)]


def test_a_loop_of_joins_keeps_its_size_estimate(spark):
    from sparkloom.storage import cut

    labels = spark.range(50).selectExpr("id", "id AS label")
    for _ in range(8):
        labels = cut(labels.join(labels.selectExpr("id AS label", "label AS next"), "label").select("id", F.least("label", "next").alias("label")))
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1_000_000
    assert labels.count() == 50


def test_hashed_computes_its_words_once(spark):
    from sparkloom.functions.vector import hashed

    texts = ["Red green, red", "", None, "..", "Ä ä b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plan = df.select(hashed(F.col("t"), 8).alias("v"))
    assert plan._jdf.queryExecution().analyzed().toString().count("xxhash64") == 1
    place = {r["w"]: r["p"] for r in spark.createDataFrame([(w,) for w in ("red", "green", "ä", "b")], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(8)).alias("p")).collect()}
    for text, row in zip(texts, plan.collect()):
        words = [w for w in re.split(r"\W+", (text or "").lower()) if w]
        counts = [sum(place[w] == i for w in words) for i in range(8)]
        length = sum(c * c for c in counts) ** 0.5
        assert row["v"] == (pytest.approx([c / length for c in counts], abs=1e-6) if words else None)


def test_distinct_rows_are_dealt_by_their_number(spark, monkeypatch):
    from sparkloom.plans import frames

    monkeypatch.setattr(frames, "TASK_ROWS", 100, raising=False)
    rows = spark.range(0, 1_000, 1, 3).selectExpr("id % 70 AS a", "id % 7 AS b", "id AS c")
    out = frames.distinct_by(rows, "a", "b")
    assert out.rdd.getNumPartitions() == 10 and sorted(map(tuple, out.collect())) == [(i, i % 7) for i in range(70)]


def test_words_of_transcripts_end_where_ascii_words_do(spark, tmp_path):
    from sparkloom.plans.text_queries import transcript_memories

    texts = [(1, 0, "user", "Nothing of note is said about éthe matters in here today"), (2, 0, "user", "Nothing of note is said about the2 matters in here today")]
    spark.createDataFrame(texts, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [(r["conv_id"], r["memory_type"]) for r in transcript_memories(spark, str(tmp_path)).collect()] == [(1, "MISTAKE")]
