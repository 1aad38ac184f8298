"""Queries over code graphs and genes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, genes, graph, indexer
from .frames import EDGES, ENTITIES, NOW, distinct_by, edges, entities, first_vector, memories, read

G = f"n AS ({ENTITIES}), e AS ({EDGES})"


def _steps(spark, sf_dir):
    """Edges among all customers: each leads to those whose orders follow its first and its last one."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).select(F.col("o_custkey").alias("s"), F.explode(F.array("a", "b")).alias("k"))
    after = orders.select((F.col("o_orderkey") - 1).alias("k"), F.col("o_custkey").alias("t"))
    return ends.join(after, "k").select("s", "t").distinct().selectExpr("s AS source_id", "t AS target_id", "'call' AS relationship_type", "'p' AS project_name", "'t' AS tenant_id")


STEPS = """f AS (SELECT o_custkey AS s, unnest([min(o_orderkey), max(o_orderkey)]) AS k FROM orders GROUP BY o_custkey),
 s AS (SELECT DISTINCT f.s, o.o_custkey AS t FROM f JOIN orders o ON o.o_orderkey = f.k + 1)"""


def god_objects(spark, sf_dir):
    return graph.god_objects(entities(spark, sf_dir), edges(spark, sf_dir), more_than=20)


def dead_code(spark, sf_dir):
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount > 0.09")
    return graph.dead_code(entities(spark, sf_dir), returned.selectExpr("concat('part:', cast(l_partkey as string)) AS target_id", "'t' AS tenant_id"))


def dead_code_unsold(spark, sf_dir):
    """Over whole edges; parts stand for code, also those that no supplier has."""
    known = distinct_by(read(spark, sf_dir, "lineitem"), "l_partkey").selectExpr("concat('part:', cast(l_partkey as string)) AS target_id", "'t' AS tenant_id")
    extra = read(spark, sf_dir, "customer").selectExpr("concat('part:', cast(c_custkey * 2 as string)) AS id", "c_name AS entity_name", "'function' AS entity_type", "'src/c.ts' AS file_path", "'t' AS tenant_id")
    return graph.dead_code(entities(spark, sf_dir).unionByName(extra), known)


def cycles_5hop(spark, sf_dir):
    return graph.on_cycles(_steps(spark, sf_dir), 5)


def scc(spark, sf_dir):
    """Customers in strong components: those of nations' own steps, so that components are of many sizes."""
    nations = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    e = _steps(spark, sf_dir).join(nations.selectExpr("c_custkey AS source_id", "c_nationkey AS a"), "source_id").join(nations.selectExpr("c_custkey AS target_id", "c_nationkey AS b"), "target_id")
    return graph.strong_components(e.where("a = b"))


def bfs_khop(spark, sf_dir):
    return graph.bfs(_steps(spark, sf_dir), spark.range(1).select(F.lit(5).cast("long").alias("id")), 3)


def both_ends(spark, sf_dir):
    nodes = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return graph.within(_steps(spark, sf_dir), nodes).select("source_id", "target_id")


def entry_points(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return graph.entry_points(customers.select("id"), _steps(spark, sf_dir), customers.where("c_acctbal > 9500"))


def call_degree(spark, sf_dir):
    return graph.call_degree(_steps(spark, sf_dir))


def labelled_edges(spark, sf_dir):
    return graph.labelled(edges(spark, sf_dir), entities(spark, sf_dir).where("id not like '%7'"), "call", "supp:1").select("source_id", "target_id", "source_label", "target_label")


def relations(spark, sf_dir):
    out = graph.with_relations(entities(spark, sf_dir).where("entity_type = 'class'"), edges(spark, sf_dir))
    return out.select("id", F.coalesce(F.size("incoming"), F.lit(0)).cast("long").alias("n_in"), F.array_join(F.transform("incoming", lambda x: x["id"]), ",").alias("callers"))


def files_of(spark, sf_dir):
    rows = entities(spark, sf_dir).withColumn("is_seed", F.col("entity_name").like("%a%"))
    return graph.files(rows).select("file_path", "n", "has_seed")


def first_edges(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return graph.first_edges(rows, ("source_id", "target_id"))


def priority_truncate(spark, sf_dir):
    rows = entities(spark, sf_dir)
    return rows.orderBy(graph.by_priority(F.col("entity_type")), "id").limit(100).select("id", "entity_type")


def type_counts(spark, sf_dir):
    return indexer.type_counts(entities(spark, sf_dir).withColumnRenamed("entity_type", "type"))


def system_flow(spark, sf_dir):
    nodes, links = graph.system_flow(entities(spark, sf_dir).where("entity_type <> 'variable'"), edges(spark, sf_dir), "full", most=50)
    return nodes.select("id", "entity_type")


def trace_summary(spark, sf_dir):
    e = _steps(spark, sf_dir)
    reached = graph.bfs(e, spark.range(1).select(F.lit(5).cast("long").alias("id")), 2).withColumn("id", F.col("id").cast("string"))
    texts = e.select(F.col("source_id").cast("string").alias("source_id"), F.col("target_id").cast("string").alias("target_id"))
    return graph.trace_summary(reached, texts)


def reading_order(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("file_path"), F.col("p_partkey").alias("ordinal"))
    return graph.reading_order(rows)


def back_edges(spark, sf_dir):
    nations = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("project_name"))
    rows = _steps(spark, sf_dir).drop("project_name").join(nations, "source_id").withColumn("ordinal", F.struct("source_id", "target_id"))
    rows = rows.withColumn("ordinal", F.format_string("%012d%012d", "source_id", "target_id"))
    return graph.back_edges(rows.withColumn("source_id", F.col("source_id").cast("string")).withColumn("target_id", F.col("target_id").cast("string")))


def call_order(spark, sf_dir):
    nations = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("project_name"), F.col("c_custkey").alias("ordinal"))
    e = _steps(spark, sf_dir).drop("project_name").join(nations.select(F.col("id").alias("source_id"), "project_name"), "source_id")
    return graph.call_order(nations, e)


def risk_score(spark, sf_dir):
    by = lambda t, c: read(spark, sf_dir, t).select(F.concat(F.lit("nation"), F.col(c).cast("string")).alias("project")).groupBy("project").agg(F.count("*").alias("n"))
    return graph.risk(by("supplier", "s_nationkey"), by("customer", "c_nationkey").where("n > 50"))


def _genes(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return rows.selectExpr(
        "cast(id AS string) AS id", "concat('gene', cast(id % 40 AS string)) AS name", "project", "'t' AS tenant_id", "concat('problem ', cast(id AS string), CASE WHEN id % 5 = 0 THEN ' prevent' ELSE '' END) AS problem",
        "concat_ws('\\n', transform(sequence(1, cast(1 + id % 7 AS int)), x -> concat('line', cast(x AS string)))) AS solution", "CASE id % 4 WHEN 0 THEN 'immune' WHEN 1 THEN 'pattern' WHEN 2 THEN 'lesson' ELSE 'workflow' END AS category",
        "confidence - 0.25e0 AS confidence", "cast(1 AS long) AS version", "cast(0 AS long) AS evolution_score", "cast(id % 5 AS long) AS usage_count", "0.5e0 AS success_rate", "embedding", "CASE WHEN id % 6 = 0 THEN 'retired' ELSE 'active' END AS status", "created_at", "created_at AS updated_at",
    )


GENES = """g AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, 'gene' || CAST(vec_id % 40 AS VARCHAR) AS name, 'p' || CAST(label % 3 AS VARCHAR) AS project, 'problem ' || CAST(vec_id AS VARCHAR) || CASE WHEN vec_id % 5 = 0 THEN ' prevent' ELSE '' END AS problem,
 CASE vec_id % 4 WHEN 0 THEN 'immune' WHEN 1 THEN 'pattern' WHEN 2 THEN 'lesson' ELSE 'workflow' END AS category, 0.3e0 + (vec_id % 7) * 0.1e0 - 0.25e0 AS confidence, vec_id % 5 AS usage_count, CASE WHEN vec_id % 6 = 0 THEN 'retired' ELSE 'active' END AS status, embedding FROM embeddings),
 q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)"""
GCOS = "list_cosine_similarity(CAST(g.embedding AS DOUBLE[]), q.v)"


def gene_search(spark, sf_dir):
    return genes.nearest(genes.active(_genes(spark, sf_dir), category="lesson"), first_vector(spark, sf_dir), 15).select("id", F.round("score", 6).alias("score"))


def gene_recommend(spark, sf_dir):
    return genes.nearest(genes.active(_genes(spark, sf_dir), least_confidence=0.3, not_project="p0"), first_vector(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


def immune_scan(spark, sf_dir):
    return genes.nearest(genes.immune(_genes(spark, sf_dir)), first_vector(spark, sf_dir), 5).select("id", F.round("score", 6).alias("score"))


def gene_list(spark, sf_dir):
    return filters.page(genes.active(_genes(spark, sf_dir)), 30, 5, F.desc("usage_count"), F.col("id").cast("long")).select("id", "usage_count")


def gene_mutate(spark, sf_dir):
    rows = _genes(spark, sf_dir)
    outcomes = rows.select("id", F.when(F.col("usage_count") % 2 == 0, "success").otherwise("failure").alias("outcome")).where("id not like '%9'")
    out = genes.mutate(rows, outcomes)
    return out.select("id", F.round("confidence", 6).alias("confidence"), F.round("success_rate", 6).alias("success_rate"), "version")


def gene_retire(spark, sf_dir):
    rows = _genes(spark, sf_dir)
    return genes.retire(rows, rows.where("category = 'lesson'").select("id"))[1]


def gene_split(spark, sf_dir):
    made, _ = genes.split_genes(_genes(spark, sf_dir), ["a", "b", "c"])
    return made.select("name", F.col("solution"), F.round("confidence", 6).alias("confidence")).groupBy("name", "solution").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def gene_merge(spark, sf_dir):
    rows = _genes(spark, sf_dir)
    made, _, _ = genes.merge_genes(rows, rows.where("category = 'pattern'").select("id"), "merged")
    return made.select(F.round("confidence", 6).alias("confidence"), F.sha2("problem", 256).alias("problem_sha"), F.size("dependencies").cast("long").alias("n"))


def gene_upsert(spark, sf_dir):
    rows = _genes(spark, sf_dir)
    known = filters.keep_first(rows, genes.GENE_KEY, F.col("id").cast("long"))
    batch = filters.keep_first(rows.where("category = 'immune'").withColumn("name", F.when(F.col("usage_count") == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name"))), genes.GENE_KEY, F.col("id").cast("long"))
    out, _ = genes.upsert_genes(known, batch.drop("id", "version", "evolution_score", "usage_count", "status", "created_at", "updated_at"), NOW)
    return out.groupBy("project", "version", "evolution_score").agg(F.count("*").alias("n"))


def gene_extract(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS content", "CASE doc_id % 3 WHEN 0 THEN 'MISTAKE' WHEN 1 THEN 'PATTERN' ELSE 'KNOWLEDGE' END AS memory_type", "source AS project", "'t' AS tenant_id")
    return genes.extract_genes(rows).select("source_id", F.sha2("name", 256).alias("name_sha"), F.sha2("problem", 256).alias("problem_sha"), F.sha2("solution", 256).alias("solution_sha"), "category")


def gene_inherit(spark, sf_dir):
    known = filters.keep_first(_genes(spark, sf_dir), genes.GENE_KEY, F.col("id").cast("long"))
    out, _ = genes.inherit(known, "p9", first_vector(spark, sf_dir), 12, NOW)
    return out.where("project = 'p9'").select("name", F.round("confidence", 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (
    god_objects, dead_code, dead_code_unsold, cycles_5hop, scc, bfs_khop, both_ends, entry_points, call_degree, labelled_edges, relations, files_of, first_edges, priority_truncate, type_counts, system_flow, trace_summary, reading_order,
    back_edges, call_order, risk_score, gene_search, gene_recommend, immune_scan, gene_list, gene_mutate, gene_retire, gene_split, gene_merge, gene_upsert, gene_extract,
)}
QUERIES["gene_inherit"] = gene_inherit

SQL = {
    "god_objects": f"WITH {G} SELECT n.entity_name, c.in_degree FROM (SELECT target_id, count(*) AS in_degree FROM e GROUP BY target_id HAVING count(*) > 20) c JOIN n ON n.id = c.target_id ORDER BY in_degree DESC, entity_name LIMIT 10",
    "dead_code": f"WITH {G} SELECT id, entity_name, entity_type, file_path FROM n WHERE entity_type IN ('function', 'class') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE 'part:' || l.l_partkey = n.id AND l_returnflag = 'R' AND l_discount > 0.09) ORDER BY entity_name, id LIMIT 20",
    "dead_code_unsold": f"""WITH {G}, a AS (SELECT id, entity_name, entity_type, file_path FROM n WHERE entity_type IN ('function', 'class') UNION ALL SELECT 'part:' || c_custkey * 2, c_name, 'function', 'src/c.ts' FROM customer)
 SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE 'part:' || l_partkey = a.id) ORDER BY entity_name, id LIMIT 20""",
    "cycles_5hop": f"""WITH RECURSIVE {STEPS}, p AS (SELECT s AS o, t AS a, 1 AS d FROM s UNION SELECT p.o, s.t, p.d + 1 FROM p JOIN s ON p.a = s.s WHERE p.d < 5 AND p.o <> p.a)
 SELECT DISTINCT o AS id FROM p WHERE o = a""",
    "scc": f"""WITH RECURSIVE {STEPS}, e AS (SELECT s.s, s.t FROM s JOIN customer a ON a.c_custkey = s.s JOIN customer b ON b.c_custkey = s.t WHERE a.c_nationkey = b.c_nationkey),
 r AS (SELECT s AS o, t AS a FROM e UNION SELECT r.o, e.t FROM r JOIN e ON e.s = r.a), m AS (SELECT x.o AS id, x.a AS other FROM r x JOIN r y ON x.o = y.a AND x.a = y.o),
 i AS (SELECT s AS id, s AS other FROM e UNION SELECT t, t FROM e UNION ALL SELECT id, other FROM m) SELECT id, min(other) AS component FROM i GROUP BY id""",
    "bfs_khop": f"""WITH RECURSIVE {STEPS}, u AS (SELECT s, t FROM s UNION SELECT t, s FROM s), p AS (SELECT CAST(5 AS BIGINT) AS id, 0 AS level UNION SELECT u.t, p.level + 1 FROM p JOIN u ON u.s = p.id WHERE p.level < 3)
 SELECT id, CAST(min(level) AS INTEGER) AS level FROM p GROUP BY id""",
    "both_ends": f"WITH {STEPS}, n AS (SELECT c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING') SELECT s AS source_id, t AS target_id FROM s WHERE s IN (SELECT s FROM n) AND t IN (SELECT s FROM n)",
    "entry_points": f"WITH {STEPS} SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9500 OR c_custkey NOT IN (SELECT t FROM s)",
    "call_degree": f"WITH {STEPS} SELECT id, count(*) AS degree FROM (SELECT s AS id FROM s UNION ALL SELECT t FROM s) GROUP BY id",
    "labelled_edges": f"WITH {G} SELECT e.source_id, e.target_id, e.source_id AS source_label, coalesce(n.entity_name, e.target_id) AS target_label FROM e LEFT JOIN n ON n.id = e.target_id AND n.id NOT LIKE '%7' WHERE contains(e.source_id, 'supp:1')",
    "relations": f"WITH {G} SELECT n.id, count(e.source_id) AS n_in, string_agg(e.source_id, ',' ORDER BY e.source_id) AS callers FROM n LEFT JOIN e ON e.target_id = n.id WHERE entity_type = 'class' GROUP BY n.id",
    "files_of": f"WITH {G} SELECT file_path, count(*) AS n, bool_or(entity_name LIKE '%a%') AS has_seed FROM n GROUP BY file_path ORDER BY has_seed DESC, n DESC, file_path LIMIT 30",
    "first_edges": "SELECT l_suppkey AS source_id, l_partkey AS target_id, min(l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem GROUP BY 1, 2",
    "priority_truncate": f"WITH {G} SELECT id, entity_type FROM n ORDER BY CASE entity_type WHEN 'module' THEN 0 WHEN 'class' THEN 1 WHEN 'function' THEN 2 ELSE 3 END, id LIMIT 100",
    "type_counts": f"WITH {G} SELECT entity_type AS type, count(*) AS n FROM n GROUP BY 1",
    "system_flow": f"WITH {G} SELECT id, entity_type FROM n WHERE entity_type <> 'variable' ORDER BY CASE entity_type WHEN 'module' THEN 0 WHEN 'class' THEN 1 ELSE 2 END, id LIMIT 50",
    "trace_summary": f"""WITH RECURSIVE {STEPS}, u AS (SELECT s, t FROM s UNION SELECT t, s FROM s), p AS (SELECT CAST(5 AS BIGINT) AS id, 0 AS level UNION SELECT u.t, p.level + 1 FROM p JOIN u ON u.s = p.id WHERE p.level < 2),
 r AS (SELECT id, min(level) AS level FROM p GROUP BY id) SELECT count(*) FILTER (WHERE level = 0) AS seeds, count(*) FILTER (WHERE level > 0) AS connected, CAST(0 AS BIGINT) AS externals, (SELECT count(*) FROM s WHERE s IN (SELECT id FROM r) AND t IN (SELECT id FROM r)) AS relationships FROM r""",
    "reading_order": "SELECT p_brand AS file_path, min(p_partkey) AS position FROM part GROUP BY 1",
    "call_order": f"""WITH RECURSIVE {STEPS}, n AS (SELECT 'n' || c_nationkey AS project_name, c_custkey AS id FROM customer),
 e AS (SELECT a.project_name AS g, s.s, s.t FROM s JOIN n a ON a.id = s.s JOIN n b ON b.id = s.t AND b.project_name = a.project_name),
 r AS (SELECT s AS o, t AS a FROM e UNION SELECT r.o, e.t FROM r JOIN e ON e.s = r.a), held AS (SELECT o AS id FROM r WHERE o = a UNION SELECT x.a FROM r x JOIN r y ON x.o = y.o AND y.o = y.a),
 w AS (SELECT id, 0 AS d FROM n WHERE id NOT IN (SELECT id FROM held) UNION SELECT e.t, w.d + 1 FROM w JOIN e ON e.s = w.id WHERE e.t NOT IN (SELECT id FROM held)), l AS (SELECT id, max(d) AS level FROM w GROUP BY id),
 k AS (SELECT id, level, [id] AS way FROM l WHERE level = 0 UNION ALL SELECT c.id, c.level, list_append(max(k.way), c.id) FROM k JOIN e ON e.s = k.id JOIN l c ON c.id = e.t AND c.level = k.level + 1 GROUP BY c.id, c.level)
 SELECT n.project_name, n.id, row_number() OVER (PARTITION BY n.project_name ORDER BY k.id IS NULL, k.level, k.way, n.id) - 1 AS position, k.id IS NOT NULL AS ordered FROM n LEFT JOIN k ON k.id = n.id""",
    "risk_score": """WITH f AS (SELECT 'nation' || s_nationkey AS project, count(*) AS n FROM supplier GROUP BY 1), c AS (SELECT 'nation' || c_nationkey AS project, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 50),
 b AS (SELECT coalesce(f.project, c.project) AS project, coalesce(f.n, 0) AS violations, coalesce(c.n, 0) AS circular FROM f FULL JOIN c ON f.project = c.project)
 SELECT project, violations, circular, CASE WHEN violations > 10 THEN 'CRITICAL' WHEN violations > 0 THEN 'HIGH' ELSE 'LOW' END AS risk, greatest(0, 100 - 5 * violations - 2 * circular) AS score FROM b""",
    "gene_search": f"WITH {GENES} SELECT id, round({GCOS}, 6) AS score FROM g, q WHERE status = 'active' AND category = 'lesson' ORDER BY {GCOS} DESC, id LIMIT 15",
    "gene_recommend": f"WITH {GENES} SELECT id, round({GCOS}, 6) AS score FROM g, q WHERE status = 'active' AND confidence >= 0.3 AND project <> 'p0' ORDER BY {GCOS} DESC, id LIMIT 10",
    "immune_scan": f"WITH {GENES} SELECT id, round({GCOS}, 6) AS score FROM g, q WHERE status = 'active' AND (confidence > 0.2 OR problem LIKE '%prevent%') AND category IN ('immune', 'pattern', 'lesson') ORDER BY {GCOS} DESC, id LIMIT 5",
    "gene_list": f"WITH {GENES} SELECT id, usage_count FROM g WHERE status = 'active' ORDER BY usage_count DESC, vec_id LIMIT 30 OFFSET 5",
    "gene_mutate": f"""WITH {GENES}, o AS (SELECT *, CASE WHEN id LIKE '%9' THEN NULL WHEN usage_count % 2 = 0 THEN 'success' ELSE 'failure' END AS outcome FROM g)
 SELECT id, round(CASE outcome WHEN 'success' THEN least(0.99, confidence + 0.05 * log2(2 + usage_count)) WHEN 'failure' THEN greatest(0.05, 0.85 * confidence) ELSE confidence END, 6) AS confidence,
 round(CAST(CASE outcome WHEN 'success' THEN (0.5 * usage_count + 1) / (usage_count + 1) WHEN 'failure' THEN 0.5 * usage_count / greatest(1, usage_count + 1) ELSE 0.5 END AS DOUBLE), 6) AS success_rate, CAST(1 + CASE WHEN outcome IS NULL THEN 0 ELSE 1 END AS BIGINT) AS version FROM o""",
    "gene_retire": f"WITH {GENES} SELECT count(*) AS retired FROM g WHERE category = 'lesson' AND status <> 'retired'",
    "gene_merge": f"WITH {GENES} SELECT round(avg(confidence), 6) AS confidence, sha256(string_agg(problem, chr(10) || chr(10) ORDER BY id)) AS problem_sha, count(*) AS n FROM g WHERE status = 'active' AND category = 'pattern'",
    "gene_split": f"""WITH {GENES}, c AS (SELECT g.*, 1 + vec_id % 7 AS n, unnest([0, 1, 2]) AS i FROM g), p AS (SELECT *, i * n // 3 AS a, (i + 1) * n // 3 AS b FROM c)
 SELECT ['a', 'b', 'c'][i + 1] AS name, CASE WHEN b > a THEN array_to_string(list_transform(range(a + 1, b + 1), lambda x: 'line' || x), chr(10)) ELSE 'Split from ' || name END AS solution, count(*) AS n, round(sum(round(0.8 * confidence, 6)), 4) AS confidence FROM p GROUP BY ALL""",
    "gene_upsert": f"""WITH {GENES}, k AS (SELECT DISTINCT name, project FROM g), b AS (SELECT DISTINCT name || CASE WHEN usage_count = 0 THEN 'x' ELSE '' END AS name, project FROM g WHERE category = 'immune'),
 u AS (SELECT project, name IN (SELECT name FROM k WHERE k.project = b.project) AS known FROM b), o AS (SELECT project, 1 AS version, 0 AS evolution_score FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.name = k.name AND b.project = k.project)
 UNION ALL SELECT project, CASE WHEN known THEN 2 ELSE 1 END, CASE WHEN known THEN 1 ELSE 0 END FROM u) SELECT project, CAST(version AS BIGINT) AS version, CAST(evolution_score AS BIGINT) AS evolution_score, count(*) AS n FROM o GROUP BY ALL""",
    "gene_extract": """WITH d AS (SELECT doc_id, doc_id % 3 AS k, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
 f AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: contains(lower(x), 'problem') OR starts_with(x, 'Task:')), true), 0) AS p, coalesce(list_position(list_transform(l, lambda x: contains(lower(x), 'solution') OR contains(lower(x), 'fix') OR starts_with(x, 'Learnings:')), true), 0) AS s FROM d)
 SELECT doc_id AS source_id, sha256(coalesce(nullif(substr(trim(l[1]), 1, 80), ''), 'Untitled Gene')) AS name_sha, sha256(CASE WHEN p > 0 THEN array_to_string(l[p:p + 2], chr(10)) ELSE substr(t, 1, 200) END) AS problem_sha,
 sha256(CASE WHEN s > 0 THEN array_to_string(l[s:s + 4], chr(10)) ELSE substr(t, 1, 300) END) AS solution_sha, CASE k WHEN 0 THEN 'immune' WHEN 1 THEN 'pattern' ELSE 'lesson' END AS category FROM f""",
    "gene_inherit": f"""WITH {GENES}, k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY name, project ORDER BY vec_id) = 1), f AS (SELECT k.* FROM k, q WHERE status = 'active' ORDER BY {GCOS.replace("g.", "k.")} DESC, id LIMIT 12)
 SELECT name, round(arg_min(greatest(0.05, least(0.99, 0.9 * confidence)), problem), 6) AS confidence FROM f GROUP BY name""",
}
