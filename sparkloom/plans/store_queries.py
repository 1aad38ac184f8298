"""Queries over stores: saving, searching with traces, listings, reports and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..functions.vector import hashed
from ..operators import filters, genes, graph, indexer, memory
from ..schema import missing_references, normalize
from ..sources import files, keyed, sqlite
from ..storage import shared_folder
from ..streaming import state, timers
from ..tenants import set_tenant, tenant_views
from .frames import ENTITIES, MEMORY, NOW, NOW_S, edges, entities, first_vector, memories, read

MEM = f"m AS (SELECT {MEMORY} FROM embeddings)"
Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


def cosine_sql(alias: str) -> str:
    return f"list_cosine_similarity(CAST({alias}.embedding AS DOUBLE[]), q.v)"


EPISODES = "event_id AS id, 'u' || cast(user_id % 20 AS string) AS project_name, event_type, props AS event_data, 't' AS tenant_id, ts AS created_at"


def episodes(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr(*EPISODES.replace("props AS event_data, ", "").split(", "), "'{\"val\": \"' || event_id || '\"}' AS event_data")
    return memory.episodes(rows, "t", "u7", "click", 40).select("id", "value")


def _entities(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "'p' || cast(label % 4 AS string) AS project_name", "embedding")


def entity_search(spark, sf_dir):
    return graph.search_entities(_entities(spark, sf_dir), first_vector(spark, sf_dir), 12, "p2").select("id", F.round("score", 6).alias("score"))


def entity_list(spark, sf_dir):
    return graph.search_entities(_entities(spark, sf_dir), None, 12, "p2").select("id", "project_name")


def _concepts(spark, sf_dir):
    return memories(spark, sf_dir).withColumn("status", F.coalesce("status", F.lit("active"))).select("id", "project", "status", "embedding", "access_count", "last_accessed_at")


def concept_search(spark, sf_dir):
    return memory.search_concepts(_concepts(spark, sf_dir), first_vector(spark, sf_dir), NOW, 8, "p1")[0].select("id", F.round("score", 6).alias("score"))


def concept_access(spark, sf_dir):
    after = memory.search_concepts(_concepts(spark, sf_dir), first_vector(spark, sf_dir), NOW, 500, "p1")[1]
    return after.select("id", F.col("access_count").cast("long").alias("access_count"), (F.unix_seconds("last_accessed_at") == NOW_S).alias("now"))


def _genes(spark, sf_dir):
    return memories(spark, sf_dir).selectExpr(
        "id", "concat('gene', cast(id % 40 AS string)) AS name", "project", "'t' AS tenant_id", "CASE id % 4 WHEN 0 THEN 'skill' WHEN 1 THEN 'pattern' WHEN 2 THEN 'lesson' ELSE 'workflow' END AS category", "confidence",
        "concat('do ', cast(id AS string)) AS description", "concat('step ', cast(id AS string)) AS solution", "concat('why ', cast(id AS string)) AS problem", "array(project, memory_type) AS dependencies", "cast(id % 5 AS long) AS usage_count",
        "cast(id % 11 AS long) AS evolution_score", "cast(1 AS long) AS version", "CASE WHEN id % 6 = 0 THEN 'retired' ELSE 'active' END AS status", "embedding", "created_at", "created_at AS updated_at",
    )


GENES = """g AS (SELECT vec_id AS id, 'gene' || vec_id % 40 AS name, 'p' || label % 3 AS project, CASE vec_id % 4 WHEN 0 THEN 'skill' WHEN 1 THEN 'pattern' WHEN 2 THEN 'lesson' ELSE 'workflow' END AS category,
 CASE label % 4 WHEN 0 THEN 'MISTAKE' WHEN 1 THEN 'PREFERENCE' WHEN 2 THEN 'PATTERN' ELSE 'KNOWLEDGE' END AS memory_type, vec_id % 5 AS usage_count, vec_id % 11 AS evolution_score, 0.3e0 + (vec_id % 7) * 0.1e0 AS confidence,
 CASE WHEN vec_id % 6 = 0 THEN 'retired' ELSE 'active' END AS status, embedding FROM embeddings)"""


def gene_usage(spark, sf_dir):
    return genes.search(_genes(spark, sf_dir), first_vector(spark, sf_dir), 20, category="lesson")[1].select("id", "usage_count")


def gene_ranking(spark, sf_dir):
    return genes.search(_genes(spark, sf_dir), first_vector(spark, sf_dir), 20, project="p1")[0].select("id", F.round("score", 6).alias("score"))


def gene_page(spark, sf_dir):
    return filters.page(genes.active(_genes(spark, sf_dir)), 500, 3, F.desc("evolution_score"), "id").select("id", "evolution_score")


def skill_search(spark, sf_dir):
    return genes.skills(_genes(spark, sf_dir), first_vector(spark, sf_dir), "PATTERN", 30).select("id", F.round("score", 6).alias("score"))


def gene_by_name(spark, sf_dir):
    return genes.by_name(_genes(spark, sf_dir), "gene8", "skill", "t").select("id", "name")


def skill_update(spark, sf_dir):
    out = genes.install_skill(_genes(spark, sf_dir).withColumn("id", F.col("id").cast("string")), "gene8", "new", "do it so", ["a", "b"], "t", NOW)
    return out.where("name = 'gene8'").select("id", "description", "solution", F.array_join("dependencies", ",").alias("tags"), "version")


def skill_install(spark, sf_dir):
    out = genes.install_skill(_genes(spark, sf_dir).withColumn("id", F.col("id").cast("string")), "brand new", "new", "do it so", ["a", "b"], "t", NOW)
    return out.groupBy("category", "version").agg(F.count("*").alias("n"))


def skill_texts(spark, sf_dir):
    return _genes(spark, sf_dir).select("id", genes.skill_text().alias("text"))


def skill_usage(spark, sf_dir):
    """Usage after a skill was made of each lesson, and of each pattern twice."""
    rows = _genes(spark, sf_dir)
    _, once = genes.generate_skills(rows, rows.where("category in ('lesson', 'pattern')").select("id"))
    texts, twice = genes.generate_skills(once, rows.where("category = 'pattern'").select("id"))
    return twice.join(texts, "id", "left").select("id", F.col("usage_count").cast("long").alias("usage_count"), F.col("text").isNotNull().alias("made"))


def immune_genes(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    made = genes.immune_gene(F.col("t"), F.reverse("t"))
    return rows.select("doc_id", *(v.alias(k) for k, v in made.items())).select("doc_id", F.sha2("name", 256).alias("name_sha"), F.sha2("problem", 256).alias("problem_sha"), F.sha2("solution", 256).alias("solution_sha"), "category", "confidence")


def immune_text(spark, sf_dir):
    found = genes.nearest(genes.active(_genes(spark, sf_dir), category="pattern"), first_vector(spark, sf_dir), 6)
    return genes.immune_context(found.withColumn("score", F.round("score", 9)))


def remaining_rows(spark, sf_dir):
    tables = {"memories": memories(spark, sf_dir).withColumn("tenant_id", F.lit("t")), "entities": _entities(spark, sf_dir).withColumn("tenant_id", F.lit("t")), "other": memories(spark, sf_dir)}
    left = memory.remove_project(tables, "p1", "t")
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def written_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    return memory.write_counts(rows.where("o_orderstatus = 'F'").select("o_custkey"), rows.where("o_orderpriority = '1-URGENT'").select("o_custkey"), ["o_custkey"])


def skipped_vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("label") == 1, F.lit(None)).when(F.col("label") == 2, F.array().cast("array<float>")).otherwise(F.col("embedding")))
    return memory.usable_vectors(rows)


def shared_contexts(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier")
    made = memory.shared_context(F.col("s_name"), F.col("s_suppkey").cast("string"), F.lit("team"), F.lit("2024-03-01"))
    return rows.select("s_suppkey", *(v.alias(k) for k, v in made.items()))


def field_checks(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("scope"), F.split("html", " ").alias("tags"))
    return rows.select("page_id", memory.valid_scope(F.col("scope")).alias("scope_ok"), memory.valid_list(F.col("tags")).alias("tags_ok"), memory.importance_of(F.col("page_id") % 12).cast("long").alias("importance"))


def saved_memories(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").selectExpr("lang AS project", "'KNOWLEDGE' AS memory_type", "source AS session_id", "text AS content", "doc_id % 10 AS importance", "doc_id")
    return memory.with_saved_fields(rows, NOW).select("doc_id", "id", "content_hash", F.round("confidence", 6).alias("confidence"))


def ingest_counts(spark, sf_dir):
    return _ingested(spark, sf_dir)[1]


def ingest_memories(spark, sf_dir):
    return _ingested(spark, sf_dir)[0].groupBy("memory_type").agg(F.count("*").alias("n"), F.sum("evidence_count").alias("evidence"))


def _ingested(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(" This is a bug that was found in the build of "), F.col("conv_id").cast("string"), F.lit("."))
    stored = normalize(spark.createDataFrame([], "id string"), "memories").select("id", "session_id", "project", "memory_type", "content", "content_hash", "importance", "confidence", "evidence_count", "created_at", "tenant_id")
    return memory.ingest(stored, read(spark, sf_dir, "conversations").withColumn("text", text), "t", NOW)


def inject_gate(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("content", F.when(F.col("id") % 4 == 0, "the weather is fine today").otherwise("a note on builds"))
    return memory.search_memories(rows, None, NOW, 40, gate_first=True).select("id", "memory_type")


def inject_gate_after(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("content", F.when(F.col("id") % 4 == 0, "the weather is fine today").otherwise("a note on builds"))
    return memory.search_memories(rows, first_vector(spark, sf_dir), F.lit(NOW).cast("timestamp"), 40, scope="auth").select("id")


def memory_ids(spark, sf_dir):
    wanted = read(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("id"))
    return filters.memory_filters(memories(spark, sf_dir), ids=wanted).select("id", "project")


def tag_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"), F.lit(None).cast("string").alias("status"))
    return filters.memory_filters(rows, tags=["fr", "src3"]).select("doc_id")


def name_contains(spark, sf_dir):
    return read(spark, sf_dir, "part").where(filters.contains_any_case(F.col("p_name"), "RE")).select("p_partkey")


def path_search(spark, sf_dir):
    rows = entities(spark, sf_dir)
    return rows.where(filters.path_matches(F.regexp_replace("file_path", "/", "\\\\"), F.col("id"), "BRAND#12\\")).select("id")


def vendor_paths(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ("a/node_modules/x.js", "my_node_modules_x/y.js", "vendor/x.php", "src/inventory.py"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", *(filters.own_code(F.col("path"), mode=m).alias(m) for m in ("substring", "path", "trace")))


def task_list(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS string) AS id", "o_orderpriority AS description", "o_orderstatus AS state", "cast(o_custkey AS string) AS leader", "cast(null AS string) AS developer")
    return filters.task_search(rows, "urgent", "O").select("id")


def _agents(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS agent_id", "array(s_name, concat('Cap', cast(s_nationkey AS string))) AS capabilities", "CASE WHEN s_acctbal > 5000 THEN 'online' ELSE 'offline' END AS status")
    return rows.withColumn("tenant_id", F.lit("t"))


def agent_discovery(spark, sf_dir):
    return filters.discover_agents(_agents(spark, sf_dir), "t", status=None, capability="cAP1", most=30).select("agent_id", "status")


def tool_list(spark, sf_dir):
    tools = read(spark, sf_dir, "nation").select(F.col("n_name").alias("tool"), "n_regionkey")
    return filters.enabled_tools(tools.select("tool"), tools.where("n_regionkey < 2").select("tool"), ["KENYA", "BRAZIL", "NATION_0", "NATION_1"])


def category_list(spark, sf_dir):
    return filters.categories(_genes(spark, sf_dir))


def user_requests(spark, sf_dir):
    return filters.activity(read(spark, sf_dir, "events"))


def truncation(spark, sf_dir):
    return filters.truncated(read(spark, sf_dir, "orders"), 500, "o_orderkey")[1]


def project_list(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        F.concat(F.when(F.col("o_orderstatus") == "P", "/home/.x/").otherwise("/work/"), F.col("o_custkey").cast("string")).alias("dir"),
        F.when(F.col("o_orderpriority") == "1-URGENT", ".git").when(F.col("o_orderpriority") == "2-HIGH", f"{files.ANALYSIS_FOLDER}/settings.json").otherwise("src").alias("child"), F.col("o_orderkey").alias("modified_at"),
    )
    return files.project_dirs(rows)


def project_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("/work/"), F.lower("n_name")).alias("dir"))
    first = rows.orderBy("name").first()["name"]
    return files.resolve_project(rows, first.lower())


def inserted_absent(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return memory.insert_absent(rows.where("c_mktsegment = 'BUILDING'"), rows.withColumn("c_mktsegment", F.lit("new")), ["c_custkey"])


def tenant_change(spark, sf_dir):
    return memory.reassign_tenant(memories(spark, sf_dir), "t0", "team").groupBy("tenant_id").agg(F.count("*").alias("n"))


def field_update(spark, sf_dir):
    return memory.update_fields(_genes(spark, sf_dir), F.col("category") == "lesson", {"name": "renamed", "description": None, "project": "p9"}).select("id", "name", "description", "project", "version")


def migrated(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier")
    target = rows.where("s_nationkey < 12").select("s_suppkey", "s_nationkey", F.lit("old").alias("origin"))
    return files.migrate(rows.where("s_nationkey > 8").withColumn("origin", F.lit("new")), target, ["s_suppkey"])


def dangling_edges(spark, sf_dir):
    links = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return missing_references(links, read(spark, sf_dir, "part").where("p_size <= 45"), "l_partkey", "p_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


def normalized_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"), F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment")).alias("status"), F.col("c_acctbal").alias("importance"))
    return normalize(rows, "memories").select("id", "status", "importance", "version", "confidence", F.col("content").isNull().alias("no_content"))


def smell_counts(spark, sf_dir):
    from .graph_queries import _steps

    customers = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS entity_name", "'function' AS entity_type", "c_mktsegment AS file_path", "'t' AS tenant_id")
    return graph.smell_report(customers, _steps(spark, sf_dir))


def persisted_nodes(spark, sf_dir):
    old = entities(spark, sf_dir).withColumn("id", F.concat(F.lit("pr_"), "id")).withColumns({"project_name": F.lit("pr"), "content": F.lit("old")})
    nodes = read(spark, sf_dir, "part").where("p_size > 25").selectExpr("concat('part:', cast(p_partkey AS string)) AS id", "'class' AS type", "p_name AS label", "p_brand AS filePath")
    links = edges(spark, sf_dir).selectExpr("source_id AS source", "target_id AS target", "relationship_type AS type")
    known = edges(spark, sf_dir).where("source_id < 'supp:5'").selectExpr("concat('pr_', source_id) AS source_id", "concat('pr_', target_id) AS target_id", "'pr' AS project_name", "relationship_type", "tenant_id")
    made, _ = graph.persist_graph(old, known, nodes, links, "pr", "t")
    return made.select("id", "entity_type", "content")


def persisted_edges(spark, sf_dir):
    none = entities(spark, sf_dir).limit(0).withColumns({"project_name": F.lit("pr"), "content": F.lit("old")})
    links = edges(spark, sf_dir).selectExpr("source_id AS source", "target_id AS target", "'import' AS type")
    known = edges(spark, sf_dir).where("source_id < 'supp:5'").selectExpr("concat('pr_', source_id) AS source_id", "concat('pr_', target_id) AS target_id", "'pr' AS project_name", "relationship_type", "tenant_id")
    nodes = read(spark, sf_dir, "part").selectExpr("cast(p_partkey AS string) AS id", "'class' AS type", "p_name AS label", "p_brand AS filePath")
    _, out = graph.persist_graph(none, known, nodes, links, "pr", "t")
    return out.groupBy("relationship_type").agg(F.count("*").alias("n"), F.countDistinct("source_id", "target_id").alias("pairs"))


def flow_of_feature(spark, sf_dir):
    from .graph_queries import _steps

    customers = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS entity_name", "CASE WHEN c_nationkey % 3 = 0 THEN 'variable' ELSE 'function' END AS entity_type")
    return graph.feature_flow(customers, _steps(spark, sf_dir), "00000007", 2, 25)


def visible_links(spark, sf_dir):
    nodes, links = graph.visible_graph(entities(spark, sf_dir), read(spark, sf_dir, "lineitem").selectExpr("concat('part:', cast(l_partkey AS string)) AS source_id", "concat('part:', cast(l_suppkey AS string)) AS target_id").distinct(), ["class", "function"], 150)
    return links


def flow_chart(spark, sf_dir):
    nodes, links = graph.system_flow(entities(spark, sf_dir), read(spark, sf_dir, "lineitem").selectExpr("concat('part:', cast(l_partkey AS string)) AS source_id", "concat('part:', cast(l_suppkey AS string)) AS target_id", "'call' AS relationship_type").distinct(), "full", most=30)
    return graph.mermaid(nodes, links)


def flow_edges(spark, sf_dir):
    links = read(spark, sf_dir, "lineitem").selectExpr("concat('part:', cast(l_partkey AS string)) AS source_id", "concat('part:', cast(l_suppkey AS string)) AS target_id", "'call' AS relationship_type")
    return graph.system_flow(entities(spark, sf_dir), links, "modules-only", most=80)[1].select("source_id", "target_id")


def flow_scope(spark, sf_dir):
    links = read(spark, sf_dir, "lineitem").selectExpr("concat('part:', cast(l_partkey AS string)) AS source_id", "concat('part:', cast(l_suppkey AS string)) AS target_id", "'call' AS relationship_type")
    return graph.system_flow(entities(spark, sf_dir), links, "feature", "brand#13/7.", most=60)[0].select("id", "entity_type")


def call_sequence(spark, sf_dir):
    calls = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS ordinal", "concat('p-', cast(l_partkey AS string)) AS source_id", "concat('s-', cast(l_suppkey AS string)) AS target_id")
    return graph.sequence_diagram(calls, 60)


def analysis_stats(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", "CASE WHEN n_nationkey % 3 > 0 THEN map('modules', n_nationkey, 'functions', n_nationkey + 1) END AS entityCounts", "CASE WHEN n_nationkey % 2 = 0 THEN map('files', n_nationkey * 10, 'functions', 7, 'classes', 3) END AS stats",
        "CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey * 100 END AS totalFilesAnalyzed",
    )
    return graph.project_stats(rows)


def project_summary(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").withColumn("project_name", F.concat(F.lit("h"), (F.length("url") % 5).cast("string")))
    nodes = pages.select("project_name", F.explode(F.array(F.lit("module"), F.when(F.col("html").contains("track("), "function"), F.lit("class"))).alias("type"))
    imports = pages.select("project_name", F.lit("a").alias("source_id"), F.lit("a").alias("target_id"), F.col("page_id").alias("ordinal")).where("page_id % 10 = 0")
    seen = pages.select("project_name", (F.length("html") > 2000).alias("skipped"))
    return graph.summary(nodes, imports, seen)


def entity_types(spark, sf_dir):
    return indexer.type_counts(entities(spark, sf_dir).withColumnRenamed("entity_type", "type"))


def context_text(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("content", F.concat(F.lit("note "), F.col("id").cast("string"))).withColumn("score", F.col("confidence"))
    return memory.context_block(rows, most=25)


def session_text(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("content", F.when(F.col("id") % 5 == 0, "a shopping list").otherwise(F.concat(F.lit("note "), F.col("id").cast("string"))))
    return memory.session_context(rows, most=25)


def concept_drafts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("lang").alias("memory_type"), F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"), F.col("text").alias("content"))
    return memory.concepts_of(memory.concept_clusters(rows)).select("project", "memory_type", "label", "confidence", "evidence_count", "status")


def consolidation(spark, sf_dir):
    """The report of a job over memories of which two labels' vectors are empty."""
    empty = F.array().cast("array<float>")
    rows = memories(spark, sf_dir).withColumn("content", F.concat(F.lit("note "), F.col("id").cast("string"))).withColumn("embedding", F.when(F.expr("(id % 10) = 7"), empty).otherwise(F.col("embedding")))
    return memory.run_consolidation(rows, NOW, threshold=0.3).report


def keyed_merge(spark, sf_dir):
    """Customers of a keyed table after two merges: the first gives every eighth a new segment, the second adds and takes away some."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(0).alias("version"))
    table = keyed.KeyedTable(spark, shared_folder(spark, "customers"))
    table.create(rows.where("c_custkey % 10 <> 3"), ["c_custkey"], buckets=16)
    table.merge(rows.where("c_custkey % 8 = 0").withColumns({"c_mktsegment": F.lit("new"), "version": F.lit(1)}), lambda old, new: memory.upsert(old, new, ["c_custkey"]))
    table.merge(rows.where("c_custkey % 10 in (3, 4)"), lambda old, new: memory.insert_absent(old, new, ["c_custkey"]).where("c_custkey % 10 <> 4 or version = 1"))
    return table.read()


def stored_orders(spark, sf_dir):
    """Orders written to a SQLite file and read back by ranges of rows, with the filter in the store's statement."""
    sqlite.register(spark)
    options = {"path": f"{shared_folder(spark, 'orders')}.db".removeprefix("file://"), "table": "orders"}
    made = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    sqlite.prepare(options["path"])
    made.write.format("sqlite").mode("append").options(**options).save()
    back = spark.read.format("sqlite").options(**options).load().where("o_orderstatus = 'F' and o_totalprice > 50000")
    return back.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def agent_transitions(spark, sf_dir):
    """When users came, fell silent for six hours, and came back: the batch form of the stream with timers."""
    beats = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("agent_id"), F.col("ts").cast("timestamp").alias("at"))
    return timers.transitions(beats, "2024-02-15 00:00:00", 6 * 3600)


def tenant_rows(spark, sf_dir):
    """Customers of one segment, the session's tenant, in a session of its own, by nation."""
    session = spark.newSession()
    tenant_views(session, {"customers_of_tenant": f"{sf_dir}/customer.parquet"}, "c_mktsegment")
    set_tenant(session, "BUILDING")
    return session.sql("SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM customers_of_tenant GROUP BY c_nationkey")


def hashed_vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", hashed(F.col("p_name"), 16).alias("v"))
    return rows.select("p_partkey", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), 5).alias("norm"), F.size("v").cast("long").alias("n"))


def reported_staleness(spark, sf_dir):
    beats = read(spark, sf_dir, "events").select(F.col("user_id").alias("agent_id"), F.col("ts").alias("at"))
    return state.latest_heartbeats(beats).select("agent_id", F.unix_seconds(F.col("registered_at").cast("timestamp")).alias("first_s"), F.unix_seconds(F.col("last_heartbeat").cast("timestamp")).alias("last_s"))


def bound_query(spark, sf_dir):
    return files.query(spark, "SELECT o_custkey, count(*) AS n FROM bound_orders WHERE o_totalprice > :least GROUP BY o_custkey", {"least": 100000.0}, bound_orders=read(spark, sf_dir, "orders"))


def unread_sessions(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    done = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("session_id"))
    return files.unprocessed(rows, done)


QUERIES = {f.__name__: f for f in (
    episodes, entity_search, entity_list, concept_search, concept_access, gene_usage, gene_ranking, gene_page, skill_search, gene_by_name, skill_update, skill_install, skill_texts, skill_usage, immune_genes, immune_text, remaining_rows, written_rows,
    skipped_vectors, shared_contexts, field_checks, saved_memories, ingest_counts, ingest_memories, inject_gate, inject_gate_after, memory_ids, tag_filter, name_contains, path_search, vendor_paths, task_list, agent_discovery, tool_list,
    category_list, user_requests, truncation, project_list, project_lookup, inserted_absent, tenant_change, field_update, migrated, dangling_edges, normalized_rows, smell_counts, persisted_nodes, persisted_edges, flow_of_feature,
    visible_links, flow_chart, flow_edges, flow_scope, call_sequence, analysis_stats, project_summary, entity_types, context_text, session_text, concept_drafts, consolidation, keyed_merge, stored_orders, agent_transitions, tenant_rows, hashed_vectors, reported_staleness, bound_query, unread_sessions,
)}

_PR = "n.entity_type IN ('module') AND"
_LINKS = "SELECT DISTINCT 'part:' || l_partkey AS source_id, 'part:' || l_suppkey AS target_id FROM lineitem"
_ORDER = "CASE entity_type WHEN 'module' THEN 0 WHEN 'class' THEN 1 WHEN 'function' THEN 2 ELSE 3 END, id"
_SAVED = """WITH d AS (SELECT doc_id, lang, source, text, doc_id % 10 AS importance, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS c FROM documents)"""


def _saved_sql() -> str:
    from .memory_queries import SQL

    gate = SQL["noise_gate"].replace("CASE WHEN doc_id % 4 = 0 THEN 'SESSION_SUMMARY' WHEN doc_id % 4 = 1 THEN 'KNOWLEDGE' ELSE 'FEEDBACK' END AS memory_type", "'KNOWLEDGE' AS memory_type")
    return f"""SELECT d.doc_id, lang || '_KNOWLEDGE_' || source || '_{NOW_S}000' AS id, sha256(text) AS content_hash,
 round(CAST(0.50 + CASE WHEN d.doc_id % 10 >= 9 THEN 0.25 WHEN d.doc_id % 10 >= 7 THEN 0.15 WHEN d.doc_id % 10 <= 3 THEN -0.15 ELSE 0 END AS DOUBLE), 6) AS confidence FROM documents d JOIN ({gate}) r ON r.doc_id = d.doc_id WHERE r.reason IS NULL"""


def _ingest_sql(select: str) -> str:
    """The drafts from transcripts, then the gate, put together from the SQL of both."""
    from .memory_queries import SQL as MEMORY_SQL
    from .text_queries import _SWAP, SQL as TEXT_SQL

    drafts = TEXT_SQL["transcript_memories"].replace(f"coalesce({_SWAP}, '')", "coalesce(text || ' This is a bug that was found in the build of ' || conv_id || '.', '')").replace("sha256(content) AS content_sha", "content")
    gate = MEMORY_SQL["noise_gate"]
    words, reason = gate[gate.index(" w AS (") :].split("\n SELECT doc_id, CASE", 1)
    trimmed = "regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '')"
    return f"""WITH x AS MATERIALIZED ({drafts}), d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, rank) AS doc_id, content, {trimmed} AS text, memory_type, importance FROM x),
{words}, g AS (SELECT doc_id, CASE{reason}) SELECT {select}"""


def _after_gate() -> str:
    from .memory_queries import RERANK

    return f"WITH {MEM}, {Q}, f AS (SELECT id FROM m, q ORDER BY {RERANK} DESC, id LIMIT 40) SELECT id FROM f WHERE id % 4 <> 0"


def _steps_sql() -> str:
    from .graph_queries import STEPS

    return STEPS


SQL = {
    "episodes": "SELECT event_id AS id, CAST(event_id AS VARCHAR) AS value FROM events WHERE user_id % 20 = 7 AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 40",
    "entity_search": f"WITH {Q} SELECT vec_id AS id, round({cosine_sql('e')}, 6) AS score FROM embeddings e, q WHERE label % 4 = 2 ORDER BY {cosine_sql('e')} DESC, vec_id LIMIT 12",
    "entity_list": "SELECT vec_id AS id, 'p2' AS project_name FROM embeddings WHERE label % 4 = 2 ORDER BY vec_id LIMIT 12",
    "concept_search": f"WITH {MEM}, {Q} SELECT id, round({cosine_sql('m')}, 6) AS score FROM m, q WHERE project = 'p1' AND coalesce(status, 'active') = 'active' ORDER BY {cosine_sql('m')} DESC, id LIMIT 8",
    "concept_access": f"""WITH {MEM}, {Q}, f AS (SELECT id FROM m, q WHERE project = 'p1' AND coalesce(status, 'active') = 'active' ORDER BY {cosine_sql('m')} DESC, id LIMIT 50)
 SELECT id, CAST(access_count + CASE WHEN id IN (SELECT id FROM f) THEN 1 ELSE 0 END AS BIGINT) AS access_count, CASE WHEN id IN (SELECT id FROM f) THEN true ELSE accessed_s = {NOW_S} END AS now FROM m""",
    "gene_usage": f"""WITH {GENES}, {Q}, f AS (SELECT id FROM g, q WHERE status = 'active' AND category = 'lesson' ORDER BY {cosine_sql('g')} DESC, id LIMIT 20)
 SELECT id, CAST(usage_count + CASE WHEN id IN (SELECT id FROM f) THEN 1 ELSE 0 END AS BIGINT) AS usage_count FROM g""",
    "gene_ranking": f"WITH {GENES}, {Q} SELECT id, round({cosine_sql('g')}, 6) AS score FROM g, q WHERE status = 'active' AND project = 'p1' ORDER BY {cosine_sql('g')} DESC, id LIMIT 20",
    "gene_page": f"WITH {GENES} SELECT id, evolution_score FROM g WHERE status = 'active' ORDER BY evolution_score DESC, id LIMIT 100 OFFSET 3",
    "skill_search": f"""WITH {GENES}, {Q}, f AS (SELECT g.*, {cosine_sql('g')} AS s FROM g, q WHERE status = 'active' AND category = 'skill' ORDER BY s DESC, id LIMIT 30) SELECT id, round(s, 6) AS score FROM f WHERE memory_type = 'PATTERN'""",
    "gene_by_name": f"WITH {GENES} SELECT id, name FROM g WHERE status = 'active' AND category = 'skill' AND name = 'gene8' ORDER BY id LIMIT 1",
    "skill_update": f"""WITH {GENES}, k AS (SELECT min(CAST(id AS VARCHAR)) AS k FROM g WHERE status = 'active' AND category = 'skill' AND name = 'gene8')
 SELECT CAST(id AS VARCHAR) AS id, CASE WHEN CAST(id AS VARCHAR) = k THEN 'new' ELSE 'do ' || id END AS description, CASE WHEN CAST(id AS VARCHAR) = k THEN 'do it so' ELSE 'step ' || id END AS solution, CASE WHEN CAST(id AS VARCHAR) = k THEN 'a,b' ELSE project || ',' || memory_type END AS tags, CASE WHEN CAST(id AS VARCHAR) = k THEN 2 ELSE 1 END AS version FROM g, k WHERE name = 'gene8'""",
    "skill_install": f"WITH {GENES} SELECT category, CAST(1 AS BIGINT) AS version, count(*) + CASE WHEN category = 'skill' THEN 1 ELSE 0 END AS n FROM g GROUP BY category",
    "skill_texts": f"""WITH {GENES} SELECT id, '---' || chr(10) || 'name: "' || name || '"' || chr(10) || 'description: "do ' || id || '"' || chr(10) || 'category: "' || category || '"' || chr(10) || '---' || chr(10) || chr(10) || '## Problem' || chr(10) || 'why ' || id || chr(10) || chr(10) || '## Solution' || chr(10) || 'step ' || id || chr(10) AS text FROM g""",
    "skill_usage": f"WITH {GENES} SELECT id, CAST(usage_count + CASE category WHEN 'lesson' THEN 1 WHEN 'pattern' THEN 2 ELSE 0 END AS BIGINT) AS usage_count, category = 'pattern' AS made FROM g",
    "immune_genes": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, sha256('[IMMUNE] ' || substr(t, 1, 70)) AS name_sha, sha256('Failure: ' || substr(t, 1, 500)) AS problem_sha,
 sha256('Prevention: ' || array_to_string(list_reverse(string_split(t, ''))[1:500], '')) AS solution_sha, 'immune' AS category, 0.7::DOUBLE AS confidence FROM d""",
    "immune_text": f"""WITH {GENES}, {Q}, f AS (SELECT g.*, round({cosine_sql('g')}, 9) AS s FROM g, q WHERE status = 'active' AND category = 'pattern' ORDER BY {cosine_sql('g')} DESC, id LIMIT 6)
 SELECT '## Known failures' || chr(10) || string_agg('- ' || name || ' (' || CAST(round(100 * confidence) AS INTEGER) || '%): step ' || id, chr(10) ORDER BY s DESC, id) AS context FROM f""",
    "remaining_rows": "SELECT 'memories' AS name, count(*) AS n FROM embeddings WHERE label % 3 <> 1 UNION ALL SELECT 'entities', count(*) FROM embeddings WHERE label % 4 <> 1 UNION ALL SELECT 'other', count(*) FROM embeddings",
    "written_rows": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
 SELECT count(*) FILTER (WHERE a.o_custkey IS NULL) AS inserted, count(a.o_custkey) AS updated FROM b LEFT JOIN a USING (o_custkey)""",
    "skipped_vectors": "SELECT count(*) FILTER (WHERE label NOT IN (1, 2)) AS usable, count(*) FILTER (WHERE label IN (1, 2)) AS skipped FROM embeddings",
    "shared_contexts": """SELECT s_suppkey, 'A2A_SHARED_CONTEXT' AS memory_type, '{"key":"' || s_name || '","value":"' || s_suppkey || '","visibility":"team","timestamp":"2024-03-01"}' AS content, 5 AS importance FROM supplier""",
    "field_checks": """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS scope, string_split(html, ' ') AS tags FROM pages)
 SELECT page_id, regexp_matches(scope, '^[a-z0-9][a-z0-9/-]{0,499}$') AS scope_ok, len(tags) <= 100 AND len(list_filter(tags, lambda x: length(x) > 100)) = 0 AS tags_ok, greatest(1, least(9, page_id % 12)) AS importance FROM p""",
    "saved_memories": _saved_sql(),
    "ingest_counts": _ingest_sql("count(*) AS extracted, count(reason) AS blocked, count(*) - count(reason) AS saved FROM g"),
    "ingest_memories": _ingest_sql("memory_type, count(DISTINCT content) AS n, count(*) AS evidence FROM d JOIN g USING (doc_id) WHERE reason IS NULL GROUP BY memory_type"),
    "inject_gate": f"WITH {MEM} SELECT id, memory_type FROM m WHERE id % 4 <> 0 ORDER BY created_s DESC, id LIMIT 40",
    "inject_gate_after": _after_gate(),
    "memory_ids": f"WITH {MEM} SELECT id, project FROM m WHERE (status IS NULL OR status IN ('active', 'superseded')) AND id IN (SELECT n_nationkey * 3 FROM nation)",
    "tag_filter": "SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3'",
    "name_contains": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 're')",
    "path_search": f"WITH n AS ({ENTITIES}) SELECT id FROM n WHERE contains(lower(file_path), 'brand#12/')",
    "vendor_paths": "SELECT page_id, page_id % 4 NOT IN (0, 1) AS substring, page_id % 4 <> 0 AS path, page_id % 4 NOT IN (0, 2) AS trace FROM pages",
    "task_list": "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus = 'O'",
    "agent_discovery": "SELECT s_suppkey AS agent_id, CASE WHEN s_acctbal > 5000 THEN 'online' ELSE 'offline' END AS status FROM supplier WHERE contains('cap' || s_nationkey, 'cap1') OR contains(lower(s_name), 'cap1') ORDER BY status DESC, s_suppkey LIMIT 30",
    "tool_list": "SELECT n_name AS tool FROM nation WHERE n_regionkey >= 2 OR n_name IN ('KENYA', 'BRAZIL', 'NATION_0', 'NATION_1')",
    "category_list": f"WITH {GENES} SELECT DISTINCT category FROM g",
    "user_requests": "SELECT user_id, count(*) AS requests, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM events GROUP BY user_id",
    "truncation": "SELECT count(*) AS total, least(count(*), 500) AS showing, count(*) > 500 AS truncated FROM orders",
    "project_list": """SELECT CAST(o_custkey AS VARCHAR) AS name, '/work/' || o_custkey AS dir, max(o_orderkey) AS modified_at FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH'))""",
    "project_lookup": "SELECT n_name AS name, '/work/' || lower(n_name) AS dir FROM nation ORDER BY n_name LIMIT 1",
    "inserted_absent": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE 'new' END AS c_mktsegment FROM customer",
    "tenant_change": f"WITH {MEM} SELECT CASE tenant_id WHEN 't0' THEN 'team' ELSE tenant_id END AS tenant_id, count(*) AS n FROM m GROUP BY 1",
    "field_update": f"""WITH {GENES} SELECT id, CASE category WHEN 'lesson' THEN 'renamed' ELSE name END AS name, 'do ' || id AS description, CASE category WHEN 'lesson' THEN 'p9' ELSE project END AS project, CASE category WHEN 'lesson' THEN 2 ELSE 1 END AS version FROM g""",
    "migrated": "SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey > 8 THEN 'new' ELSE 'old' END AS origin FROM supplier",
    "dangling_edges": "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY 1",
    "normalized_rows": "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_nationkey > 12 THEN c_mktsegment ELSE 'active' END AS status, c_acctbal AS importance, 1 AS version, 0.5::DOUBLE AS confidence, true AS no_content FROM customer",
    "smell_counts": f"""WITH RECURSIVE {_steps_sql()}, p AS (SELECT s AS o, t AS a, 1 AS d FROM s UNION SELECT p.o, s.t, p.d + 1 FROM p JOIN s ON p.a = s.s WHERE p.d < 5 AND p.o <> p.a)
 SELECT 'cycles' AS smell, count(DISTINCT o) AS n FROM p WHERE o = a UNION ALL SELECT 'god_objects', least(10, count(*)) FROM (SELECT t FROM s GROUP BY t HAVING count(*) > 15) UNION ALL SELECT 'dead_code', least(20, count(*)) FROM customer WHERE c_custkey NOT IN (SELECT t FROM s)""",
    "persisted_nodes": f"""WITH n AS ({ENTITIES}) SELECT 'pr_part:' || p_partkey AS id, 'class' AS entity_type, 'Entity: ' || p_name || ', Type: class, Path: ' || p_brand AS content FROM part WHERE p_size > 25
 UNION ALL SELECT 'pr_' || n.id, n.entity_type, 'old' FROM n JOIN part ON n.id = 'part:' || p_partkey WHERE p_size <= 25""",
    "persisted_edges": """WITH e AS (SELECT DISTINCT 'supp:' || l_suppkey AS s, l_partkey FROM lineitem) SELECT CASE WHEN s < 'supp:5' THEN 'call' ELSE 'import' END AS relationship_type, count(*) AS n, count(*) AS pairs FROM e GROUP BY 1""",
    "flow_of_feature": f"""WITH RECURSIVE {_steps_sql()}, u AS (SELECT s, t FROM s UNION SELECT t, s FROM s), d AS (SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '00000007')),
 p AS (SELECT id, 0 AS level FROM d UNION SELECT u.t, p.level + 1 FROM p JOIN u ON u.s = p.id WHERE p.level < 2), r AS (SELECT id, min(level) AS level FROM p GROUP BY id),
 c AS (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM s UNION ALL SELECT t FROM s) GROUP BY id)
 SELECT r.id, level = 0 AS is_seed, coalesce(degree, 0) AS degree FROM r JOIN customer ON c_custkey = r.id LEFT JOIN c ON c.id = r.id WHERE c_nationkey % 3 <> 0 ORDER BY is_seed DESC, degree DESC, r.id LIMIT 25""",
    "visible_links": f"WITH n AS ({ENTITIES}), v AS (SELECT id FROM n WHERE entity_type IN ('class', 'function') ORDER BY id LIMIT 150), e AS ({_LINKS}) SELECT source_id, target_id FROM e WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)",
    "flow_chart": f"""WITH n AS ({ENTITIES}), v AS (SELECT * FROM n ORDER BY {_ORDER} LIMIT 30), e AS ({_LINKS}), k AS (SELECT '  ' || regexp_replace(id, '[^0-9A-Za-z_]', '_', 'g') || '["' || entity_name || '"]' AS x FROM v),
 l AS (SELECT '  ' || regexp_replace(source_id, '[^0-9A-Za-z_]', '_', 'g') || ' -->|call| ' || regexp_replace(target_id, '[^0-9A-Za-z_]', '_', 'g') AS x FROM e WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v))
 SELECT concat_ws(chr(10), 'flowchart TD', (SELECT string_agg(x, chr(10) ORDER BY x) FROM k), (SELECT string_agg(x, chr(10) ORDER BY x) FROM l)) AS diagram""",
    "flow_edges": f"WITH n AS ({ENTITIES}), v AS (SELECT id FROM n WHERE entity_type = 'module' ORDER BY id LIMIT 80), e AS ({_LINKS}) SELECT source_id, target_id FROM e WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)",
    "flow_scope": f"""WITH n AS ({ENTITIES}), e AS ({_LINKS}), f AS (SELECT id FROM n WHERE contains(lower(entity_name), 'brand#13/7.') OR contains(lower(file_path), 'brand#13/7.')),
 x AS (SELECT id FROM f UNION SELECT target_id FROM e WHERE source_id IN (SELECT id FROM f) UNION SELECT source_id FROM e WHERE target_id IN (SELECT id FROM f)) SELECT id, entity_type FROM n WHERE id IN (SELECT id FROM x) ORDER BY {_ORDER} LIMIT 60""",
    "call_sequence": """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS o, 'p_' || l_partkey AS s, 's_' || l_suppkey AS t FROM lineitem ORDER BY o, s, t LIMIT 60) SELECT 'sequenceDiagram' || chr(10) || string_agg('  ' || s || '->>' || t || ': calls', chr(10) ORDER BY o, s, t) AS diagram FROM c""",
    "analysis_stats": """WITH a AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END AS em, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey + 1 END AS ef, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 END AS sf,
 CASE WHEN n_nationkey % 2 = 0 THEN 7 END AS sfn, CASE WHEN n_nationkey % 2 = 0 THEN 3 END AS sc, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey * 100 END AS t FROM nation)
 SELECT CAST(coalesce(sf, t, em, 0) AS BIGINT) AS files, CAST(coalesce(em, sf, t, 0) AS BIGINT) AS modules, CAST(coalesce(ef, sfn, 0) AS BIGINT) AS functions, CAST(coalesce(sc, 0) AS BIGINT) AS classes,
 CAST(0 AS BIGINT) AS dependencies, CAST(0 AS BIGINT) AS "circularDeps", CAST(0 AS BIGINT) AS "deadCode" FROM a""",
    "project_summary": """WITH p AS (SELECT *, 'h' || length(url) % 5 AS project_name FROM pages) SELECT project_name, count(*) AS n_module, count(*) AS n_class, count(*) FILTER (WHERE contains(html, 'track(')) AS n_function,
 count(*) FILTER (WHERE page_id % 10 = 0) AS circular, count(*) FILTER (WHERE length(html) <= 2000) AS analyzed, count(*) FILTER (WHERE length(html) > 2000) AS skipped FROM p GROUP BY project_name""",
    "entity_types": f"WITH n AS ({ENTITIES}) SELECT entity_type AS type, count(*) AS n FROM n GROUP BY 1",
    "context_text": f"""WITH {MEM}, f AS (SELECT * FROM m ORDER BY confidence DESC, id LIMIT 25) SELECT '## Relevant memories' || chr(10) || string_agg('- [' || memory_type || '] (' || printf('%.2f', confidence) || ') note ' || id, chr(10) ORDER BY confidence DESC, id) AS context FROM f""",
    "session_text": f"""WITH {MEM}, f AS (SELECT * FROM m WHERE id % 5 <> 0 ORDER BY importance DESC, id LIMIT 25) SELECT '# Session context' || chr(10) || chr(10) || string_agg('### ' || memory_type || ' (' || importance || ')' || chr(10) || 'note ' || id, chr(10) || chr(10) ORDER BY importance DESC, id) AS context FROM f""",
    "concept_drafts": "SELECT source AS project, lang AS memory_type, 'Pattern: ' || lang || ' in ' || source AS label, 0.7::DOUBLE AS confidence, count(*) AS evidence_count, 'active' AS status FROM documents GROUP BY source, lang HAVING count(*) >= 2",
    "consolidation": f"""WITH RECURSIVE {MEM}, v AS (SELECT * FROM m WHERE id % 10 <> 7),
 p AS (SELECT a.tenant_id || '/' || a.project AS t, a.id AS x, b.id AS y, a.importance < b.importance AS later_weighs, row_number() OVER (PARTITION BY a.tenant_id, a.project ORDER BY a.created_s, a.id, b.created_s, b.id) AS n FROM v a JOIN v b
 ON a.tenant_id = b.tenant_id AND a.project = b.project AND a.id < b.id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.30),
 r AS (SELECT DISTINCT t, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS gone FROM p UNION ALL
 SELECT r.t, p.n, CASE WHEN list_contains(gone, x) OR list_contains(gone, y) THEN gone ELSE list_append(gone, CASE WHEN later_weighs THEN x ELSE y END) END FROM r JOIN p ON p.t = r.t AND p.n = r.n + 1),
 dead AS (SELECT unnest(arg_max(gone, n)) AS id FROM r GROUP BY t), k AS (SELECT * FROM m WHERE id NOT IN (SELECT id FROM dead)),
 c AS (SELECT count(*) AS n FROM k WHERE id % 10 <> 7 GROUP BY project, memory_type HAVING count(*) >= 2),
 a1 AS (SELECT *, coalesce(status, 'active') AS st, CASE WHEN accessed_s IS NOT NULL THEN pow(0.995, floor(({NOW_S} - accessed_s) / 86400.0)) ELSE pow(0.997, floor(({NOW_S} - created_s) / 86400.0)) END AS f FROM k),
 a2 AS (SELECT *, CASE WHEN st = 'active' THEN greatest(0.05, confidence * f) ELSE confidence END AS c0 FROM a1),
 a3 AS (SELECT *, CASE WHEN st = 'active' AND evidence_count > 1 THEN least(0.99, greatest(0.05, c0 + 0.05 * log2(evidence_count + 1))) ELSE c0 END AS c1 FROM a2),
 a4 AS (SELECT *, CASE WHEN st = 'active' AND access_count > 0 THEN least(0.99, greatest(0.05, c1 + 0.02 * log2(access_count + 1))) ELSE c1 END AS c2 FROM a3),
 l AS (SELECT * FROM a4 WHERE st = 'active' AND c2 >= 0.10),
 s AS (SELECT DISTINCT a.id FROM l a JOIN l b ON a.id % 10 <> 7 AND b.id % 10 <> 7 AND a.tenant_id = b.tenant_id AND a.project = b.project AND a.memory_type = b.memory_type AND a.id < b.id AND b.c2 > a.c2
 AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.30)
 SELECT step, CAST(n AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS error FROM (SELECT 'processed' AS step, count(*) AS n FROM m UNION ALL SELECT 'skipped_vectors', count(*) FROM m WHERE id % 10 = 7 UNION ALL SELECT 'duplicates_removed', count(*) FROM dead
 UNION ALL SELECT 'concepts_made', count(*) FROM c UNION ALL SELECT 'concepts_raised', count(*) FROM c UNION ALL SELECT 'archived', count(*) FROM a4 WHERE st = 'active' AND c2 < 0.10 UNION ALL SELECT 'superseded', count(*) FROM s)""",
    "agent_transitions": """WITH b AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS agent_id, epoch_us(ts) // 1000 AS ms FROM events), w AS (SELECT *, lag(ms) OVER (PARTITION BY agent_id ORDER BY ms) AS before, lead(ms) OVER (PARTITION BY agent_id ORDER BY ms) AS after FROM b)
 SELECT agent_id, 'online' AS status, ms AS at_ms FROM w WHERE before IS NULL OR ms > before + 21600000
 UNION ALL SELECT agent_id, 'offline', ms + 21600000 FROM w WHERE coalesce(after, epoch_ms(TIMESTAMP '2024-02-15')) > ms + 21600000""",
    "tenant_rows": "SELECT c_nationkey, count(*) AS n, CAST(1 AS BIGINT) AS segments FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey",
    "keyed_merge": """SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 AND c_custkey % 10 <> 3 THEN 'new' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 8 = 0 AND c_custkey % 10 <> 3 THEN 1 ELSE 0 END AS version
 FROM customer WHERE c_custkey % 10 <> 4 OR c_custkey % 8 = 0""",
    "stored_orders": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000 GROUP BY o_custkey",
    "hashed_vectors": "SELECT p_partkey, 1.0::DOUBLE AS norm, CAST(16 AS BIGINT) AS n FROM part",
    "reported_staleness": "SELECT user_id AS agent_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM events GROUP BY user_id",
    "bound_query": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000.0 GROUP BY o_custkey",
    "unread_sessions": "SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
}
