"""Code graphs as two frames: entities and edges."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cosine, literal
from ..storage import cut
from .filters import keep_first
from .rounds import first_in_first_out, strong_components


def god_objects(entities: DataFrame, edges: DataFrame, more_than: int = 15, top: int = 10) -> DataFrame:
    """entity_name and in_degree of the most referenced entities. Edges are counted before the join, which then moves one row an entity."""
    counts = edges.groupBy(F.col("target_id").alias("id"), "tenant_id").agg(F.count("*").alias("in_degree")).where(F.col("in_degree") > more_than)
    return counts.join(entities.select("id", "tenant_id", "entity_name"), ["id", "tenant_id"]).select("entity_name", "in_degree").orderBy(F.desc("in_degree"), "entity_name").limit(top)


def dead_code(entities: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """Functions and classes that nothing refers to."""
    used = edges.select(F.col("target_id").alias("id"), "tenant_id")
    rows = entities.where(F.col("entity_type").isin("function", "class")).join(used, ["id", "tenant_id"], "left_anti")
    return rows.select("id", "entity_name", "entity_type", "file_path").orderBy("entity_name", "id").limit(most)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node connected with it) of the ends of edges (a, b), by large and small stars.

    Edges are aggregated by node before they move; each round is checkpointed.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    loops = ends.select(F.col("u").alias("node")).union(ends.select(F.col("v").alias("node"))).distinct()
    now = cut(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low)
        now = cut(small.distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    known = now.groupBy("u").agg(F.min("v").alias("component"))
    return loops.join(known, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))


def on_cycles(edges: DataFrame, hops: int = 5) -> DataFrame:
    """id of each node from which at most so many edges lead back to it.

    A cycle lies in one strong component, so that only edges inside components
    are walked. Walks start at their nodes and go half the hops, as distinct
    (origin, node) pairs; longer cycles are those whose walk meets one that comes
    back to the origin, which is a shorter walk read backwards. Jobs run while
    this is called.
    """
    e = edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).distinct()
    part = cut(strong_components(edges))
    e = e.join(part.selectExpr("id as s", "component as c"), "s").join(part.selectExpr("id as t", "component as d"), "t").where("c = d").select("s", "t")
    e = cut(e)
    ahead = (hops + 1) // 2
    walks = [e.select(F.col("s").alias("origin"), F.col("t").alias("at"))]
    for _ in range(ahead - 1):
        walks.append(cut(walks[-1].join(e, F.col("at") == F.col("s")).select("origin", F.col("t").alias("at")).distinct()))
    found = [w.where("origin = at").select(F.col("origin").alias("id")) for w in walks]
    for back in walks[: hops - ahead]:
        home = back.select(F.col("at").alias("origin"), F.col("origin").alias("at"))
        found.append(walks[-1].join(home, ["origin", "at"], "left_semi").select(F.col("origin").alias("id")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 2, types: Sequence[str] = (), undirected: bool = True) -> DataFrame:
    """(id, level) of nodes within depth steps of the seeds (ids), at their smallest level."""
    e = edges.where(F.col("relationship_type").isin(list(types))) if types else edges
    step = e.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    step = (step.union(step.select("v", "u")) if undirected else step).distinct()
    step = cut(step)
    frontier = cut(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    seen = frontier
    for level in range(1, depth + 1):
        new = frontier.join(step, F.col("id") == F.col("u")).select(F.col("v").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = cut(new.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def first_edges(edges: DataFrame, keys: Sequence[str] = ("source_id", "target_id", "relationship_type"), ordinal: str = "ordinal") -> DataFrame:
    return keep_first(edges, keys, ordinal)


def labelled(edges: DataFrame, entities: DataFrame, relation: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    """Edges with the labels of their ends (the id where there is no node), filtered by relation and parts of labels."""
    names = entities.select("id", "entity_name")
    for side in ("source", "target"):
        edges = edges.join(names.select(F.col("id").alias(f"{side}_id"), F.col("entity_name").alias(f"_{side}")), f"{side}_id", "left").withColumn(f"{side}_label", F.coalesce(f"_{side}", f"{side}_id")).drop(f"_{side}")
    for name, wanted in (("source_label", source), ("target_label", target)):
        if wanted:
            edges = edges.where(F.contains(F.lower(name), F.lit(wanted.lower())))
    return edges.where(F.col("relationship_type") == relation) if relation else edges


def with_relations(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """Each match with its incoming and outgoing relations as sorted arrays of struct<type, id>."""
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("relationship_type").alias("type"), F.col("target_id").alias("id")))).alias("outgoing"))
    into = edges.groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("relationship_type").alias("type"), F.col("source_id").alias("id")))).alias("incoming"))
    return matches.join(into, "id", "left").join(out, "id", "left")


def files(nodes: DataFrame, most: int = 30) -> DataFrame:
    """file_path, n, has_seed and entities of each file: seeds first, then the fullest."""
    out = nodes.groupBy("file_path").agg(F.count("*").alias("n"), F.max("is_seed").alias("has_seed"), F.array_sort(F.collect_list(F.struct("entity_type", "entity_name"))).alias("entities"))
    return out.orderBy(F.desc("has_seed"), F.desc("n"), "file_path").limit(most)


def call_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def entry_points(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes without an edge from inside, and seeds."""
    top = nodes.select("id").join(within(edges, nodes).select(F.col("target_id").alias("id")), "id", "left_anti")
    return top.union(nodes.select("id").join(seeds.select("id"), "id", "left_semi")).distinct()


# What is shown first where a list is cut.
PRIORITY = {"module": 0, "class": 1, "function": 2, "variable": 3}


def by_priority(kind: Column) -> Column:
    out = F.lit(99)
    for name, n in PRIORITY.items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def system_flow(entities: DataFrame, edges: DataFrame, scope: str = "modules-only", feature: str | None = None, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a scope: modules only, all, or what a feature's nodes touch; at most so many nodes, edges once."""
    if scope == "modules-only":
        nodes = entities.where("entity_type = 'module'")
    elif scope == "feature" and feature:
        found = entities.where(F.contains(F.lower("entity_name"), F.lit(feature.lower())) | F.contains(F.lower(F.coalesce("file_path", "id")), F.lit(feature.lower())))
        near = edges.join(found.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"))
        near = near.union(edges.join(found.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id")))
        nodes = entities.join(near.union(found.select("id")).distinct(), "id", "left_semi")
    else:
        nodes = entities
    nodes = nodes.orderBy(by_priority(F.col("entity_type")), "id").limit(most)
    return nodes, within(edges, nodes).dropDuplicates(["source_id", "target_id", "relationship_type"])


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, diagram: a flowchart of the nodes and edges."""
    n = nodes.agg(F.array_sort(F.collect_list(F.concat(F.lit("  "), F.regexp_replace("id", "[^0-9A-Za-z_]", "_"), F.lit('["'), "entity_name", F.lit('"]')))).alias("a"))
    arrow = F.concat(F.lit("  "), F.regexp_replace("source_id", "[^0-9A-Za-z_]", "_"), F.lit(" -->|"), "relationship_type", F.lit("| "), F.regexp_replace("target_id", "[^0-9A-Za-z_]", "_"))
    e = edges.agg(F.array_sort(F.collect_list(arrow)).alias("b"))
    return n.join(e).select(F.array_join(F.concat(F.array(F.lit("flowchart TD")), "a", "b"), "\n").alias("diagram"))


def reading_order(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Files by first occurrence."""
    return rows.groupBy("file_path").agg(F.min(ordinal).alias("position")).orderBy("position")


def trace_summary(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """seeds, connected and external nodes, and relationships among the reached."""
    a = reached.agg(F.sum((F.col("level") == 0).cast("long")).alias("seeds"), F.sum((F.col("level") > 0).cast("long")).alias("connected"), F.sum(F.col("id").startswith("external:").cast("long")).alias("externals"))
    return a.join(within(edges, reached).agg(F.count("*").alias("relationships")))


def back_edges(edges: DataFrame, group: str = "project_name") -> DataFrame:
    """Edges that close a cycle in a depth-first walk, counted by project; nodes and neighbours go by first appearance (ordinal).

    The walk is sequential, so a project is one task; only its import edges go there.
    """

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        neighbours: dict[str, list[str]] = {}
        for a, b in pdf.sort_values("ordinal")[["source_id", "target_id"]].itertuples(index=False):
            neighbours.setdefault(a, []).append(b)
        state: dict[str, int] = {}
        count = 0
        for start in list(neighbours):
            if start in state:
                continue
            state[start] = 1
            stack = [(start, iter(neighbours[start]))]
            while stack:
                node, rest = stack[-1]
                for nxt in rest:
                    if nxt not in state:
                        state[nxt] = 1
                        stack.append((nxt, iter(neighbours.get(nxt, ()))))
                        break
                    count += state[nxt] == 1
                else:
                    state[node] = 2
                    stack.pop()
        return pd.DataFrame({group: [key[0]], "circular": [count]})

    kind = dict(edges.dtypes)[group]
    return edges.select(group, "source_id", "target_id", "ordinal").groupBy(group).applyInPandas(walk, f"{group} {kind}, circular long")


def call_order(nodes: DataFrame, edges: DataFrame, group: str = "project_name") -> DataFrame:
    """(group, id, position, ordered): callers before callees, first in first out by ordinal; nodes on cycles, or behind them, follow at the end with ordered false."""
    return first_in_first_out(nodes, edges, group)


def persist_graph(old_entities: DataFrame, old_edges: DataFrame, nodes: DataFrame, links: DataFrame, project: str, tenant: str) -> tuple[DataFrame, DataFrame]:
    """Entities and edges after a project's analysis: nodes replace those of equal id, links are added if absent."""
    from .memory import insert_absent, upsert

    text = F.concat(F.lit("Entity: "), "label", F.lit(", Type: "), "type", F.lit(", Path: "), F.coalesce("filePath", F.lit("")))
    made = nodes.select(F.concat(F.lit(f"{project}_"), "id").alias("id"), F.lit(project).alias("project_name"), F.col("type").alias("entity_type"), F.col("label").alias("entity_name"), F.col("filePath").alias("file_path"), text.alias("content"), F.lit(tenant).alias("tenant_id"))
    prefixed = links.select(F.concat(F.lit(f"{project}_"), "source").alias("source_id"), F.concat(F.lit(f"{project}_"), "target").alias("target_id"), F.lit(project).alias("project_name"), F.col("type").alias("relationship_type"), F.lit(tenant).alias("tenant_id"))
    return upsert(old_entities, made, ["id"]), insert_absent(old_edges, prefixed, ["source_id", "target_id", "project_name", "tenant_id"])


def smell_report(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """smell and n, one row for each kind."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("smell"), "n")
    return one(on_cycles(edges), "cycles").union(one(god_objects(entities, edges), "god_objects")).union(one(dead_code(entities, edges), "dead_code"))


# Where each count of an analysis is looked for, in this order.
STATS = {
    "files": ("stats.files", "totalFilesAnalyzed", "entityCounts.modules"),
    "modules": ("entityCounts.modules", "stats.files", "totalFilesAnalyzed"),
    "functions": ("entityCounts.functions", "stats.functions"),
    "classes": ("entityCounts.classes", "stats.classes"),
    "dependencies": ("entityCounts.dependencies", "stats.dependencies"),
    "circularDeps": ("entityCounts.circularDeps", "stats.circularDeps"),
    "deadCode": ("entityCounts.deadCode", "stats.deadCode"),
}


def project_stats(analysis: DataFrame) -> DataFrame:
    """The counts of each analysis (structs or maps stats and entityCounts, and totalFilesAnalyzed), each from the first place that has it, else 0."""
    return analysis.select(*(F.coalesce(*(F.col(c) for c in places), F.lit(0)).cast("long").alias(name) for name, places in STATS.items()))


def summary(nodes: DataFrame, imports: DataFrame, files: DataFrame, group: str = "project_name") -> DataFrame:
    """A row a project: nodes of each type, circular imports, files analysed and skipped.

    Frames of (project, type), (project, source_id, target_id, ordinal) and (project, skipped).
    """
    count = lambda kind: F.count_if(F.col("type") == kind).alias(f"n_{kind}")
    counts = nodes.groupBy(group).agg(*map(count, ("module", "class", "function")))
    read = files.groupBy(group).agg(F.count_if(~F.col("skipped")).alias("analyzed"), F.count_if("skipped").alias("skipped"))
    out = counts.join(back_edges(imports, group), group, "left").join(read, group, "left")
    return out.na.fill(0, ["circular", "analyzed", "skipped"])


def search_entities(entities: DataFrame, query: Sequence[float] | None, limit: int = 10, project: str | None = None) -> DataFrame:
    """The entities nearest to query, or, without one, the first by id, unranked."""
    rows = entities.where(F.col("project_name") == project) if project else entities
    if query is None:
        return rows.withColumn("score", F.lit(None).cast("double")).orderBy("id").limit(limit)
    rows = rows.where(F.size("embedding") > 0).withColumn("score", cosine(F.col("embedding"), literal(query)))
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def feature_flow(entities: DataFrame, edges: DataFrame, feature: str, depth: int = 3, most: int = 50) -> DataFrame:
    """id, is_seed and degree of the functions and classes around those named after a feature: seeds first, then by calls, most at most."""
    seeds = cut(entities.where(F.contains(F.lower("entity_name"), F.lit(feature.lower()))).select("id"))
    near = bfs(edges, seeds, depth, types=("call", "contains"))
    rows = entities.where(F.col("entity_type").isin("function", "class")).join(near.select("id", "level"), "id")
    calls = call_degree(edges.where("relationship_type = 'call'"))
    rows = rows.join(calls, "id", "left").select("id", (F.col("level") == 0).alias("is_seed"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return rows.orderBy(F.desc("is_seed"), F.desc("degree"), "id").limit(most)


def visible_graph(nodes: DataFrame, edges: DataFrame, types: Sequence[str], most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes of these types, the first most by id; edges with both ends among them)."""
    shown = nodes.where(F.col("entity_type").isin(list(types))).orderBy("id").limit(most)
    return shown, within(edges, shown)


def sequence_diagram(calls: DataFrame, most: int = 100) -> DataFrame:
    """One row, diagram: a sequence diagram of calls (ordinal, source_id, target_id), the first most of them."""
    name = lambda c: F.regexp_replace(c, "[^0-9A-Za-z_]", "_")
    first = calls.orderBy("ordinal", "source_id", "target_id").limit(most)
    lines = F.array_sort(F.collect_list(F.struct("ordinal", "source_id", "target_id")))
    arrows = F.transform(lines, lambda x: F.concat(F.lit("  "), name(x["source_id"]), F.lit("->>"), name(x["target_id"]), F.lit(": calls")))
    return first.agg(F.array_join(F.concat(F.array(F.lit("sequenceDiagram")), arrows), "\n").alias("diagram"))


def risk(findings: DataFrame, cycles: DataFrame) -> DataFrame:
    """project, violations, circular, risk, score; frames of (project, n) each."""
    both = findings.select("project", F.col("n").alias("violations")).join(cycles.select("project", F.col("n").alias("circular")), "project", "full_outer").na.fill(0, ["violations", "circular"])
    level = F.when(F.col("violations") > 10, "CRITICAL").when(F.col("violations") > 0, "HIGH").otherwise("LOW")
    return both.select("project", "violations", "circular", level.alias("risk"), F.greatest(F.lit(0), 100 - 5 * F.col("violations") - 2 * F.col("circular")).alias("score"))


