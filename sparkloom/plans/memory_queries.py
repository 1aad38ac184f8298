"""Queries over memories and concepts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import BLOCKLIST, LEAST_IMPORTANCE, STOP_WORDS, content_hash, noise_reason
from ..functions.vector import cosine, literal, parse
from ..operators import filters, memory
from .frames import MEMORY, NOW, NOW_S, first_vector, memories, read

MEM = f"m AS (SELECT {MEMORY} FROM embeddings)"
Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)"
COS = "list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), q.v)"
RERANK = f"""0.5 * {COS} + 0.2 * confidence + CASE WHEN evidence_count > 0 THEN 0.05 * least(1.0, log2(evidence_count + 1) / 5) ELSE 0 END
 + CASE WHEN scope = 'auth' THEN 0.30 WHEN starts_with(scope, 'auth/') THEN 0.15 ELSE 0 END
 + 0.15 * (1 - least(1.0, greatest(0.0, ({NOW_S} - created_s) / 86400.0 / 90))) + 0.10 * importance / 10"""


def vector_topk(spark, sf_dir):
    return memory.vector_topk(memories(spark, sf_dir), first_vector(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


def vector_topk_filtered(spark, sf_dir):
    rows = memory_rows = memories(spark, sf_dir)
    rows = filters.memory_filters(filters.scoped(memory_rows, "t0"), project="p1", types="mistake, pattern", scope="auth")
    return memory.vector_topk(rows, first_vector(spark, sf_dir), 10, weight=0.5).withColumn("score", F.round("score", 6))


def vector_rerank(spark, sf_dir):
    rows = filters.memory_filters(memories(spark, sf_dir).withColumn("content", F.lit("a note")))
    out = memory.search_memories(rows, first_vector(spark, sf_dir), F.lit(NOW).cast("timestamp"), 20, 5, scope="auth")
    return out.select("id", "memory_type", F.round("score", 6).alias("score"))


def memory_page(spark, sf_dir):
    return filters.page(filters.memory_filters(memories(spark, sf_dir)), 25, 10, F.desc("created_at"), "id").select("id", "project", "importance")


def memory_dates(spark, sf_dir):
    return filters.memory_filters(memories(spark, sf_dir), after="2024-01-03T00:00:00", before="2024-01-05T12:00:00", with_status=False).select("id", "created_s")


def near_dup_pairs(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return memory.similar_pairs(rows, [], ["created_at"], 0.35).select("earlier", "later", F.round("similarity", 6).alias("similarity"))


def supersede(spark, sf_dir):
    return memory.superseded_ids(memories(spark, sf_dir), 0.30, ("tenant_id", "project"))


def greedy_dedup(spark, sf_dir):
    return memory.greedy_duplicates(memories(spark, sf_dir), 0.30, ("tenant_id",))


def cosine_guard(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.lit(None)).when(F.col("vec_id") % 5 == 1, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 5 == 2, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("e"))
    return rows.select("vec_id", F.round(cosine(F.col("e"), literal(first_vector(spark, sf_dir))), 6).alias("similarity"))


def vector_parse(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, "[]").when(F.col("vec_id") % 3 == 1, "oops").otherwise(F.format_string("[%d, 2.5]", "vec_id")).alias("s"))
    return rows.select("vec_id", F.size(F.coalesce(parse(F.col("s")), F.array().cast("array<float>"))).cast("long").alias("n"))


def content_hash_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def keep_latest(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project"), F.col("lang").alias("memory_type"), F.when(F.col("doc_id") % 10 != 0, content_hash(F.col("text"))).alias("content_hash"), F.lit("t").alias("tenant_id"))
    return memory.keep_latest(rows, "doc_id").select("doc_id", "content_hash")


def upsert_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("p").alias("project"), F.col("lang").alias("memory_type"), content_hash(F.col("text")).alias("content_hash"), F.lit("t").alias("tenant_id"),
        (F.col("doc_id") % 10).cast("double").alias("importance"), ((F.col("doc_id") % 7) / 10).alias("confidence"), F.lit(1).cast("long").alias("evidence_count"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("scope"), F.col("doc_id").alias("created_at"),
    )
    old, new = rows.where("created_at % 2 = 0"), rows.where("created_at % 2 = 1")
    start = memory.upsert_merge(old.limit(0), old)
    out = memory.upsert_merge(start, new)
    return out.select("content_hash", "importance", F.round("confidence", 6).alias("confidence"), "evidence_count", "created_at")


def bump_counter(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return memory.bump(rows, rows.where("id % 10 = 3").select("id"), "access_count").select("id", F.col("access_count").cast("long").alias("access_count"))


def upsert_overwrite(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(0).alias("version"))
    new = rows.where("c_custkey % 4 = 0").withColumn("version", F.lit(1)).unionByName(rows.where("c_custkey % 8 = 0").withColumn("version", F.lit(2)))
    return memory.upsert(rows, new, ["c_custkey"], "version")


def lifecycle(spark, sf_dir):
    return memory.lifecycle(memories(spark, sf_dir), NOW).select("id", F.round("confidence", 6).alias("confidence"), "status")


def initial_confidence(spark, sf_dir):
    rows = memories(spark, sf_dir).select("id", "memory_type", "importance")
    return rows.select("id", F.round(memory.initial_confidence(F.col("memory_type"), F.col("importance")), 6).alias("confidence"))


def noise_gate(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "SESSION_SUMMARY").when(F.col("doc_id") % 4 == 1, "KNOWLEDGE").otherwise("FEEDBACK").alias("memory_type"), (F.col("doc_id") % 10).alias("importance"))
    return rows.select("doc_id", noise_reason(F.col("text"), F.col("memory_type"), F.col("importance")).alias("reason"))


def concept_clusters(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("lang").alias("memory_type"), F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"), F.col("text").alias("content"))
    return memory.concept_clusters(rows).select("project", "memory_type", "size", F.sha2("summary", 256).alias("summary_sha"), F.array_join("source_ids", ",").alias("ids"))


def concept_confidence(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("source").agg((F.count("*") % 12).alias("evidence"), (F.min("doc_id") % 9 / 10).alias("c"))
    return rows.select("source", F.round(memory.concept_confidence(F.col("c"), F.col("evidence")), 6).alias("confidence"))


def outcome_memories(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").otherwise("partial").alias("outcome"), "props")
    content, importance = memory.outcome_memory(F.col("outcome"), F.col("props"))
    return rows.select("event_id", F.get_json_object(content, "$.outcome").alias("outcome"), importance.alias("importance"))


def tag_any(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return filters.memory_filters(rows, tags=["fr", "src3"], with_status=False).select("doc_id")


def scope_prefix(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return rows.where(filters.in_scope(F.col("scope"), "auth")).groupBy("scope").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_filtered, vector_rerank, memory_page, memory_dates, near_dup_pairs, supersede, greedy_dedup, cosine_guard, vector_parse, content_hash_dedup, keep_latest, upsert_merge,
    bump_counter, upsert_overwrite, lifecycle, initial_confidence, noise_gate, concept_clusters, concept_confidence, outcome_memories, tag_any, scope_prefix,
)}

_IN = "('" + "', '".join(STOP_WORDS) + "')"
_BLOCKED = " ".join(f"WHEN regexp_matches(lower(trim(text)), '{p.replace(chr(39), chr(39) * 2)}') THEN 'blocklist: {r}'" for p, r in BLOCKLIST)
_LEAST = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST_IMPORTANCE.items())

SQL = {
    "vector_topk": f"WITH {MEM}, {Q} SELECT id, round({COS}, 6) AS score FROM m, q ORDER BY {COS} DESC, id LIMIT 10",
    "vector_topk_filtered": f"""WITH {MEM}, {Q} SELECT id, round(0.5 * {COS}, 6) AS score FROM m, q WHERE tenant_id = 't0' AND project = 'p1' AND memory_type IN ('MISTAKE', 'PATTERN')
 AND (scope = 'auth' OR starts_with(scope, 'auth/')) AND (status IS NULL OR status IN ('active', 'superseded')) ORDER BY {COS} DESC, id LIMIT 10""",
    "vector_rerank": f"""WITH {MEM}, {Q} SELECT id, memory_type, round({RERANK}, 6) AS score FROM m, q WHERE status IS NULL OR status IN ('active', 'superseded') ORDER BY {RERANK} DESC, id LIMIT 20 OFFSET 5""",
    "memory_page": f"WITH {MEM} SELECT id, project, importance FROM m WHERE status IS NULL OR status IN ('active', 'superseded') ORDER BY created_s DESC, id LIMIT 25 OFFSET 10",
    "memory_dates": f"WITH {MEM} SELECT id, created_s FROM m WHERE created_s >= 1704240000 AND created_s <= 1704456000",
    "near_dup_pairs": f"""WITH {MEM} SELECT earlier, later, round(s, 6) AS similarity FROM (SELECT a.id AS earlier, b.id AS later, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
 FROM m a JOIN m b ON a.id < b.id) WHERE s > 0.35""",
    "supersede": f"""WITH {MEM}, l AS (SELECT * FROM m WHERE coalesce(status, 'active') = 'active') SELECT a.id, min(b.id) AS superseded_by FROM l a JOIN l b ON a.tenant_id = b.tenant_id AND a.project = b.project AND a.id < b.id
 AND b.confidence > a.confidence AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.30 GROUP BY a.id""",
    "greedy_dedup": f"""WITH RECURSIVE {MEM}, p AS (SELECT a.tenant_id AS t, a.id AS x, b.id AS y, a.importance < b.importance AS later_weighs, row_number() OVER (PARTITION BY a.tenant_id ORDER BY a.created_s, a.id, b.created_s, b.id) AS n FROM m a JOIN m b
 ON a.tenant_id = b.tenant_id AND a.id < b.id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.30),
 r AS (SELECT DISTINCT t, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS gone FROM p UNION ALL
 SELECT r.t, p.n, CASE WHEN list_contains(gone, x) OR list_contains(gone, y) THEN gone ELSE list_append(gone, CASE WHEN later_weighs THEN x ELSE y END) END FROM r JOIN p ON p.t = r.t AND p.n = r.n + 1)
 SELECT unnest(arg_max(gone, n)) AS id FROM r GROUP BY t""",
    "cosine_guard": f"WITH {Q} SELECT vec_id, CASE WHEN vec_id % 5 < 3 THEN 0.0::DOUBLE ELSE round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 6) END AS similarity FROM embeddings, q",
    "vector_parse": "SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 2 THEN 2 ELSE 0 END AS BIGINT) AS n FROM embeddings",
    "content_hash_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
    "keep_latest": """WITH d AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 10 <> 0 THEN sha256(text) END AS content_hash FROM documents)
 SELECT max(doc_id) AS doc_id, content_hash FROM d WHERE content_hash IS NOT NULL GROUP BY source, lang, content_hash UNION ALL SELECT doc_id, content_hash FROM d WHERE content_hash IS NULL""",
    "upsert_merge": """SELECT sha256(text) AS content_hash, max(CAST(doc_id % 10 AS DOUBLE)) AS importance, round(max((doc_id % 7) / 10.0), 6)::DOUBLE AS confidence, CAST(count(*) AS BIGINT) AS evidence_count, min(doc_id) AS created_at
 FROM documents GROUP BY lang, text""",
    "bump_counter": f"WITH {MEM} SELECT id, CAST(access_count + CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END AS BIGINT) AS access_count FROM m",
    "upsert_overwrite": "SELECT c_custkey, c_mktsegment, CAST(CASE WHEN c_custkey % 8 = 0 THEN 2 WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS version FROM customer",
    "lifecycle": f"""WITH {MEM}, a AS (SELECT *, coalesce(status, 'active') AS st, CASE WHEN accessed_s IS NOT NULL THEN pow(0.995, floor(({NOW_S} - accessed_s) / 86400.0)) ELSE pow(0.997, floor(({NOW_S} - created_s) / 86400.0)) END AS f FROM m),
 b AS (SELECT *, CASE WHEN st = 'active' THEN greatest(0.05, confidence * f) ELSE confidence END AS c0 FROM a),
 c AS (SELECT *, CASE WHEN st = 'active' AND evidence_count > 1 THEN least(0.99, greatest(0.05, c0 + 0.05 * log2(evidence_count + 1))) ELSE c0 END AS c1 FROM b),
 d AS (SELECT *, CASE WHEN st = 'active' AND access_count > 0 THEN least(0.99, greatest(0.05, c1 + 0.02 * log2(access_count + 1))) ELSE c1 END AS c2 FROM c)
 SELECT id, round(c2, 6) AS confidence, CASE WHEN st = 'active' AND c2 < 0.10 THEN 'archived' ELSE st END AS status FROM d""",
    "initial_confidence": f"""WITH {MEM} SELECT id, round(CAST(greatest(0.05, least(0.99, CASE memory_type WHEN 'MISTAKE' THEN 0.65 WHEN 'PREFERENCE' THEN 0.55 WHEN 'PATTERN' THEN 0.60 ELSE 0.50 END
 + CASE WHEN importance >= 9 THEN 0.25 WHEN importance >= 7 THEN 0.15 WHEN importance <= 3 THEN -0.15 ELSE 0 END)) AS DOUBLE), 6) AS confidence FROM m""",
    "noise_gate": f"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text, CASE WHEN doc_id % 4 = 0 THEN 'SESSION_SUMMARY' WHEN doc_id % 4 = 1 THEN 'KNOWLEDGE' ELSE 'FEEDBACK' END AS memory_type, doc_id % 10 AS importance FROM documents),
 w AS (SELECT *, list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x <> '') AS words FROM d)
 SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < CASE WHEN memory_type = 'SESSION_SUMMARY' THEN 100 ELSE 40 END THEN 'too short' WHEN length(text) > CASE WHEN memory_type = 'SESSION_SUMMARY' THEN 5000 ELSE 2000 END THEN 'too long'
 WHEN importance < CASE memory_type {_LEAST} ELSE 2 END THEN 'importance' WHEN len(words) > 0 AND len(list_filter(words, lambda x: x IN {_IN})) / len(words) > 0.8 THEN 'stop words' {_BLOCKED} END AS reason FROM w""",
    "concept_clusters": """WITH d AS (SELECT source, lang, doc_id, text AS c, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)
 SELECT source AS project, lang AS memory_type, count(*) AS size, sha256(string_agg(c, ' | ' ORDER BY doc_id) FILTER (WHERE n <= 5)) AS summary_sha, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM d GROUP BY source, lang HAVING count(*) >= 2""",
    "concept_confidence": """WITH d AS (SELECT source, count(*) % 12 AS e, (min(doc_id) % 9) / 10.0 AS c FROM documents GROUP BY source), r AS (SELECT *, least(0.99, c + (1 - c) * (1 - exp(-0.2 * e))) AS n FROM d)
 SELECT source, round(CAST(CASE WHEN abs(n - c) > 0.01 THEN n ELSE c END AS DOUBLE), 6) AS confidence FROM r""",
    "outcome_memories": "SELECT event_id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'partial' END AS outcome, CAST(CASE event_type WHEN 'error' THEN 10 WHEN 'purchase' THEN 5 ELSE 3 END AS INTEGER) AS importance FROM events",
    "tag_any": "SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3'",
    "scope_prefix": f"WITH {MEM} SELECT scope, count(*) AS n FROM m WHERE scope = 'auth' OR starts_with(scope, 'auth/') GROUP BY scope",
}
