"""Queries over texts, source lines, registries and time, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import capped_json, episode_value, identifier_words, js_regex, slug, tags_of, tool_request
from ..operators import filters, indexer, scanner, transcripts
from ..operators.memory import keep_latest
from ..streaming import state
from .frames import read


def transcript_memories(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    # the invented prose has few of the rules' words: the most common words of two languages stand for three of them
    words = {"the": "error", "des": "prefer", "der": "always"}
    text = F.col("text")
    for a, b in words.items():
        text = F.regexp_replace(text, js_regex(rf"(?i)\b{a}\b"), b)
    return transcripts.classify(transcripts.build(rows.withColumn("text", text))).select("conv_id", "rank", "memory_type", "importance", F.sha2("content", 256).alias("content_sha"))


def small_talk(spark, sf_dir):
    return transcripts.build(read(spark, sf_dir, "conversations")).select("conv_id", transcripts.small_talk(F.col("transcript")).alias("reload"), F.length("transcript").cast("long").alias("chars"))


def identifier_tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("get"), F.initcap(F.regexp_replace("p_name", " ", "")), F.lit("HTTPKey_v"), F.col("p_size").cast("string")).alias("name"))
    return rows.select("p_partkey", F.array_join(identifier_words(F.col("name")), " ").alias("words"))


def _code_nodes(spark, sf_dir):
    """Nodes named after events: secrets, unsafe calls and queries among them."""
    return read(spark, sf_dir, "events").selectExpr(
        "cast(event_id AS string) AS id", "CASE event_id % 2 WHEN 0 THEN 'variable' ELSE 'function' END AS type",
        "CASE event_id % 12 WHEN 0 THEN 'authToken' WHEN 2 THEN 'tokenCount' WHEN 4 THEN 'api_key' WHEN 6 THEN 'keyName' WHEN 8 THEN 'userPassword' WHEN 10 THEN 'total' WHEN 1 THEN 'eval' WHEN 3 THEN 'runQuery' WHEN 5 THEN 'executeUseCase' WHEN 7 THEN 'execute' ELSE 'render' END AS label",
        "CASE event_id % 7 WHEN 0 THEN 'src/tests/a.ts' WHEN 1 THEN 'src/db/a.ts' ELSE 'src/ui/a.ts' END AS filePath", "event_id AS line",
    )


NODES = """n AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id, CASE event_id % 2 WHEN 0 THEN 'variable' ELSE 'function' END AS type,
 CASE event_id % 12 WHEN 0 THEN 'authToken' WHEN 2 THEN 'tokenCount' WHEN 4 THEN 'api_key' WHEN 6 THEN 'keyName' WHEN 8 THEN 'userPassword' WHEN 10 THEN 'total' WHEN 1 THEN 'eval' WHEN 3 THEN 'runQuery' WHEN 5 THEN 'executeUseCase' WHEN 7 THEN 'execute' ELSE 'render' END AS label,
 event_id % 7 AS m FROM events)"""


def vulnerability_scan(spark, sf_dir):
    nodes = _code_nodes(spark, sf_dir)
    links = nodes.where("cast(id AS long) % 24 = 3").selectExpr("id AS source", "cast(cast(id AS long) + 1 AS string) AS target")
    named = nodes.withColumn("label", F.when(F.col("id").cast("long") % 48 == 4, "sqlPool").otherwise(F.col("label")))
    return scanner.findings(named, links).select("id", "severity", "type")


def call_extract(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"), F.col("html").alias("content"))
    _, links = indexer.index(rows)
    return links.where("type = 'call'").groupBy("target").agg(F.count("*").alias("n"))


def index_nodes(spark, sf_dir):
    """Definitions by line, and links by kind, of whole pages that are read as four languages, each with some code behind."""
    code = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("src/m"), F.col("page_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ("ts", "py", "go", "php"))), (F.col("page_id") % 4 + 1).cast("int")))
    nodes, links = indexer.index(read(spark, sf_dir, "pages").select(path.alias("path"), F.concat(F.coalesce("html", F.lit("")), F.lit("\n"), code).alias("content")))
    a = nodes.where("type <> 'module'").groupBy("type", "label", "line").agg(F.count("*").alias("n"))
    b = links.groupBy("type").agg(F.count("*").alias("n")).select("type", F.lit("").alias("label"), F.lit(0).alias("line"), "n")
    return a.unionByName(b)


#: Code in TypeScript, Python, Go and PHP.
SNIPPETS = (
    "export class A {}\nasync function go(x) { if (x) run(x) }\nimport { b } from './b'",
    "class B:\n  def __init__(self): pass\n  def run (self): pass\nfrom .c import d",
    "type T struct {\nfunc (t *T) Run() {\nfunc hidden() {",
    "abstract CLASS P {\n  public FUNCTION q() {}",
)


def episodic_decode(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"val": "v'), F.col("event_id").cast("string"), F.lit('"}'))).when(F.col("event_id") % 3 == 1, "{broken").otherwise(F.col("props")).alias("data"))
    return rows.select("event_id", episode_value(F.col("data")).alias("value"))


def slugs(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", slug(F.col("url")).alias("slug"))


def tag_lists(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('["'), "lang", F.lit('","'), "source", F.lit('"]'))).otherwise(F.concat("lang", F.lit(" , ,"), "source")).alias("tags"))
    return rows.select("doc_id", F.array_join(tags_of(F.col("tags")), "|").alias("tags"))


def tool_requests(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"tool":"t'), F.col("event_id").cast("string"), F.lit('","params":{"n":'), F.col("event_id").cast("string"), F.lit("}}"))).when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit(" now"))).otherwise("  ").alias("s"))
    return rows.select("event_id", tool_request(F.col("s"))["tool"].alias("tool"), tool_request(F.col("s"))["params"].alias("params"))


def capped_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(capped_json(F.col("text")), 256).alias("text_sha"))


def vendor_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, "a/node_modules/x.js").when(F.col("page_id") % 4 == 1, "vendor/x.php").when(F.col("page_id") % 4 == 2, "a\\venv\\x.py").otherwise("src/inventory.py").alias("path"))
    return rows.where(filters.own_code(F.col("path"), mode="trace")).select("page_id")


def index_coverage(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("a"), (F.col("n_nationkey") % 3).alias("b"))
    return rows.select("n_nationkey", indexer.coverage(F.col("a"), F.col("b")).alias("percent"))


def agent_staleness(spark, sf_dir):
    beats = state.latest_heartbeats(read(spark, sf_dir, "events").select(F.col("user_id").alias("agent_id"), F.col("ts").alias("at")))
    return state.with_staleness(beats, "2024-01-30 12:00:00", after_s=86_400).select("agent_id", "status")


def agent_counts(spark, sf_dir):
    beats = state.with_staleness(state.latest_heartbeats(read(spark, sf_dir, "events").select(F.col("user_id").alias("agent_id"), F.col("ts").alias("at"))), "2024-01-30 12:00:00", after_s=86_400)
    return beats.agg(F.count("*").alias("total"), F.sum((F.col("status") == "online").cast("long")).alias("online"))


def merged_agents(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("http://a"), (F.col("s_suppkey") % 60).cast("string")).alias("agent_url"), F.col("s_suppkey").alias("agent_id"))
    return filters.merged_agents(rows.where("agent_id % 2 = 0"), rows.where("agent_id % 2 = 1"))


def rate_limit(spark, sf_dir):
    return state.rate_limit(read(spark, sf_dir, "events"), limit=2, window_ms=86_400_000)


def user_activity(spark, sf_dir):
    return filters.activity(read(spark, sf_dir, "events"))


def event_sessions(spark, sf_dir):
    rows = state.sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours")
    return rows.select("user_id", F.unix_seconds("started").alias("started_s"), "n")


def cron_runs(spark, sf_dir):
    minutes = spark.sql("SELECT explode(sequence(timestamp'2024-01-01 00:00:00', timestamp'2024-01-31 23:59:00', interval 1 minute)) AS at")
    return state.cron_runs(minutes, "30 2 * * 1").select(F.unix_seconds("run_at").alias("run_s"))


def task_machine(spark, sf_dir):
    to = F.element_at(F.array(*map(F.lit, ("created", "assigned", "implemented", "fixes_needed", "implemented", "approved"))), (F.row_number().over(_by_user()) % 6 + F.when(F.row_number().over(_by_user()) % 6 == 0, 6).otherwise(0)).cast("int"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task_id"), F.lit("t").alias("tenant_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), to.alias("to"), F.lit("").alias("note"))
    return state.task_states(rows).select("task_id", "state", F.size("history").alias("steps"), "rejected")


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def latest_event(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lit("h").alias("content_hash"))
    return keep_latest(rows, "event_id", ("user_id", "event_type")).select("event_id", "user_id", "event_type")


QUERIES = {f.__name__: f for f in (
    transcript_memories, small_talk, identifier_tokens, vulnerability_scan, call_extract, index_nodes, episodic_decode, slugs, tag_lists, tool_requests, capped_texts, vendor_filter, index_coverage,
    agent_staleness, agent_counts, merged_agents, rate_limit, user_activity, event_sessions, cron_runs, task_machine, latest_event,
)}

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_LINES = f"""f AS (SELECT page_id % 4 AS k, coalesce(html, '') || chr(10) || CASE page_id % 4 {" ".join(f"WHEN {i} THEN {_quoted(x)}" for i, x in enumerate(SNIPPETS))} END AS content FROM pages),
 l AS (SELECT k, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM f)"""


def _rule(n: int) -> str:
    cases = " ".join(f"WHEN {i} THEN regexp_extract(x, {_quoted(indexer.RULES[name][n])}, 1)" for i, name in enumerate(("ts", "py", "go", "php")))
    return f"CASE k {cases} END"


_CALL_NAMES = "('" + "', '".join(indexer.NOT_CALLS) + "')"
_INDEX_SQL = f"""WITH {_LINES}, d AS (SELECT k, line, 'class' AS type, {_rule(0)} AS label FROM l UNION ALL SELECT k, line, 'function', {_rule(1)} FROM l),
 g AS (SELECT type, label, line FROM d WHERE label <> '' AND NOT (type = 'function' AND k = 1 AND label = '__init__') AND NOT (type = 'function' AND k = 2 AND NOT regexp_matches(label, '^[A-Z]'))),
 c AS (SELECT unnest(regexp_extract_all(x, '(\\w+)\\(', 1)) AS name FROM l WHERE k = 0),
 i AS (SELECT k, CASE WHEN k = 0 THEN coalesce(nullif(regexp_extract(x, {_quoted(indexer.TS_IMPORT)}, 1), ''), regexp_extract(x, {_quoted(indexer.TS_IMPORT)}, 2))
 WHEN k = 1 THEN coalesce(nullif(regexp_extract(x, {_quoted(indexer.PY_IMPORT)}, 1), ''), trim(split_part(regexp_extract(x, {_quoted(indexer.PY_IMPORT)}, 2), ',', 1))) ELSE '' END AS goal FROM l)
 SELECT type, label, CAST(line AS INTEGER) AS line, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT 'contains', '', 0, count(*) FROM g UNION ALL SELECT 'call', '', 0, count(*) FROM c WHERE name NOT IN {_CALL_NAMES}
 UNION ALL SELECT 'import', '', 0, count(*) FROM i WHERE starts_with(goal, '.') OR (k = 0 AND starts_with(goal, '/'))"""

_TRIM = "regexp_replace(regexp_replace({}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')"
_SWAP = "text"
for _a, _b in {"the": "error", "des": "prefer", "der": "always"}.items():
    _SWAP = f"array_to_string(list_transform(regexp_split_to_array({_SWAP}, '(?i)\\b{_a}\\b'), lambda x: x), '{_b}')"
_MET = lambda pattern: f"regexp_matches(s, '{pattern}')"
_TRANSCRIPT_SQL = f"""WITH c AS (SELECT conv_id, turn, upper(role) AS role, coalesce({_SWAP}, '') AS text FROM conversations WHERE role IN ('user', 'assistant')),
 t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS segment, role, {_TRIM.format("text")} AS body FROM c),
 p AS (SELECT conv_id, segment, role, unnest(regexp_split_to_array(body, '[.!?]+')) AS x, generate_subscripts(regexp_split_to_array(body, '[.!?]+'), 1) AS place FROM t WHERE length(body) >= 30),
 q AS (SELECT *, {_TRIM.format("x")} AS sentence FROM p), l AS (SELECT *, lower(sentence) AS s FROM q WHERE length(sentence) > 30),
 k AS (SELECT *, CASE WHEN {_MET(transcripts.MISTAKE)} THEN 'MISTAKE' WHEN {_MET(transcripts.PREFERENCE)} THEN 'PREFERENCE' WHEN {_MET(transcripts.PATTERN)} THEN 'PATTERN' WHEN {_MET(transcripts.FIX)} THEN 'KNOWLEDGE'
 WHEN role = 'ASSISTANT' AND length(s) > 120 AND {_MET(transcripts.ENGINEERING)} THEN 'KNOWLEDGE' END AS memory_type FROM l),
 i AS (SELECT *, CASE WHEN memory_type = 'MISTAKE' THEN CASE WHEN {_MET(transcripts.GRAVE)} THEN 8 ELSE 6 END WHEN memory_type IN ('PREFERENCE', 'PATTERN') THEN 6 WHEN {_MET(transcripts.FIX)} THEN 5 ELSE 4 END AS importance, substr(sentence, 1, 300) AS content
 FROM k WHERE memory_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, substr(s, 1, 60) ORDER BY segment, place) = 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, segment, place) AS rank FROM i QUALIFY rank <= 10)
 SELECT conv_id, CAST(rank AS INTEGER) AS rank, memory_type, CAST(importance AS INTEGER) AS importance, sha256(content) AS content_sha FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, memory_type, substr(content, 1, 40) ORDER BY rank) = 1"""

_STALE = "SELECT user_id AS agent_id, CASE WHEN epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(max(ts)) > 86400 THEN 'offline' ELSE 'online' END AS status FROM events GROUP BY user_id"

SQL = {
    "small_talk": """WITH t AS (SELECT conv_id, string_agg('[' || upper(role) || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS x FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
 SELECT conv_id, contains(lower(x), 'weather') OR contains(lower(x), 'thanks') OR contains(lower(x), 'sunny') AS reload, length(x) AS chars FROM t""",
    "identifier_tokens": """WITH n AS (SELECT p_partkey, 'get' || upper(substr(replace(p_name, ' ', ''), 1, 1)) || lower(substr(replace(p_name, ' ', ''), 2)) || 'HTTPKey_v' || p_size AS name FROM part)
 SELECT p_partkey, lower(replace(replace(replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '_', ' '), '.', ' '), '-', ' ')) AS words FROM n""",
    "vulnerability_scan": f"""WITH {NODES} SELECT id, 'HIGH' AS severity, 'HARDCODED_SECRET' AS type FROM n WHERE type = 'variable' AND m <> 0 AND label IN ('authToken', 'api_key', 'userPassword') AND event_id % 48 <> 4
 UNION ALL SELECT id, 'CRITICAL', 'UNSAFE_FUNCTION' FROM n WHERE label = 'eval' AND m <> 0
 UNION ALL SELECT id, 'MEDIUM', 'SQL_INJECTION_RISK' FROM n WHERE label = 'runQuery' AND m <> 0 AND (m = 1 OR (event_id % 24 = 3 AND event_id + 1 IN (SELECT event_id FROM n) AND ((event_id + 1) % 48 = 4 OR (event_id + 1) % 7 = 1)))""",
    "call_extract": """WITH c AS (SELECT 'p' || page_id || '.ts' AS path, unnest(regexp_extract_all(html, '(\\w+)\\(', 1)) AS name FROM pages)
 SELECT 'function:module:' || path || ':' || name AS target, count(*) AS n FROM c WHERE name NOT IN ('if', 'while', 'for', 'switch', 'catch', 'then', 'return', 'throw', 'console', 'typeof') GROUP BY 1""",
    "episodic_decode": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'v' || event_id WHEN 1 THEN '{broken' ELSE props END AS value FROM events",
    "slugs": "SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS slug FROM pages",
    "tag_lists": "SELECT doc_id, lang || '|' || source AS tags FROM documents",
    "tool_requests": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 't' || event_id WHEN 1 THEN event_type ELSE 'default' END AS tool, CASE event_id % 3 WHEN 0 THEN '{"n":' || event_id || '}' ELSE '{}' END AS params FROM events""",
    "capped_texts": "SELECT doc_id, sha256(CASE WHEN length(text) > 10000 THEN substr(text, 1, 10000) || chr(10) || '... (truncated)' ELSE text END) AS text_sha FROM documents",
    "vendor_filter": "SELECT page_id FROM pages WHERE page_id % 4 = 3",
    "index_coverage": "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 5 + n_nationkey % 3 = 0 THEN 100 ELSE round(100.0 * (n_nationkey % 5) / (n_nationkey % 5 + n_nationkey % 3)) END AS INTEGER) AS percent FROM nation",
    "agent_staleness": _STALE,
    "agent_counts": f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'online') AS online FROM ({_STALE})",
    "merged_agents": "SELECT 'http://a' || s_suppkey % 60 AS agent_url, arg_min(s_suppkey, (s_suppkey % 2) * 1000000 + s_suppkey) AS agent_id FROM supplier GROUP BY 1",
    "user_activity": "SELECT user_id, count(*) AS requests, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM events GROUP BY user_id",
    "event_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started_s, count(*) AS n FROM b GROUP BY user_id, s""",
    "cron_runs": "SELECT CAST(epoch(TIMESTAMP '2024-01-01 02:30:00' + to_days(CAST(d AS INTEGER))) AS BIGINT) AS run_s FROM range(31) t(d) WHERE dayofweek(DATE '2024-01-01' + CAST(d AS INTEGER)) = 1",
    "latest_event": "SELECT max(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
 r AS (SELECT user_id, event_id, n, [ms] AS kept, true AS accepted FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.n, CASE WHEN len(list_filter(r.kept, lambda x: e.ms - x < 86400000)) < 2 THEN list_append(list_filter(r.kept, lambda x: e.ms - x < 86400000), e.ms) ELSE list_filter(r.kept, lambda x: e.ms - x < 86400000) END,
 len(list_filter(r.kept, lambda x: e.ms - x < 86400000)) < 2 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, event_id, accepted FROM r""",
    "task_machine": """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 s AS (SELECT task_id, n, ['created', 'assigned', 'implemented', 'fixes_needed', 'implemented', 'approved'][(n - 1) % 6 + 1] AS goal FROM e),
 r AS (SELECT task_id, 1 AS n, 'created' AS state, 1 AS steps, 0 AS rejected FROM s WHERE n = 1 UNION ALL
 SELECT task_id, n + 1, CASE WHEN ok THEN goal ELSE state END, steps + CASE WHEN ok THEN 1 ELSE 0 END, rejected + CASE WHEN ok THEN 0 ELSE 1 END
 FROM (SELECT r.*, goal, (state = 'created' AND goal = 'assigned') OR (state = 'assigned' AND goal = 'implemented') OR (state = 'implemented' AND goal IN ('fixes_needed', 'approved')) OR (state = 'fixes_needed' AND goal = 'implemented') AS ok
 FROM r JOIN s ON s.task_id = r.task_id AND s.n = r.n + 1))
 SELECT task_id, arg_max(state, n) AS state, CAST(arg_max(steps, n) AS INTEGER) AS steps, CAST(arg_max(rejected, n) AS BIGINT) AS rejected FROM r GROUP BY task_id""",
    "index_nodes": _INDEX_SQL,
    "transcript_memories": _TRANSCRIPT_SQL,
}
