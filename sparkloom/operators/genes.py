"""Genes: versioned lessons that are searched, merged, split, mutated and passed on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cosine, literal
from .filters import keep_first
from .graph import cut
from .memory import bump, clamp

GENE_KEY = ("name", "project", "tenant_id")


def active(genes: DataFrame, project: str | None = None, category: str | None = None, least_confidence: float | None = None, not_project: str | None = None) -> DataFrame:
    out = genes.where("status = 'active'")
    out = out.where(F.col("project") == project) if project else out
    out = out.where(F.col("category") == category) if category else out
    out = out.where(F.col("project") != not_project) if not_project else out
    return out if least_confidence is None else out.where(F.col("confidence") >= least_confidence)


def immune(genes: DataFrame) -> DataFrame:
    """Active genes that may warn: confident, or about prevention, and of a fitting category."""
    problem = F.lower("problem")
    about = F.contains(problem, F.lit("immune")) | F.contains(problem, F.lit("prevent")) | F.contains(problem, F.lit("failure"))
    return genes.where((F.col("status") == "active") & ((F.col("confidence") > 0.2) | about) & F.col("category").isin("immune", "pattern", "lesson"))


def nearest(genes: DataFrame, query: Sequence[float], limit: int, most: int = 50) -> DataFrame:
    """genes with score, the nearest first; none is changed."""
    rows = genes.where(F.size("embedding") > 0).withColumn("score", cosine(F.col("embedding"), literal(query)))
    return rows.orderBy(F.desc("score"), "id").limit(max(1, min(limit, most)))


def search(genes: DataFrame, query: Sequence[float], limit: int = 10, project: str | None = None, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the nearest active genes with score, all genes after those were used once more)."""
    found = cut(nearest(active(genes, project, category), query, limit).select("id", "score"))
    ranked = genes.join(F.broadcast(found), "id").orderBy(F.desc("score"), "id")  # 50 rows at most
    return ranked, bump(genes, found, "usage_count")


def skills(genes: DataFrame, query: Sequence[float], tag: str | None = None, most: int = 50) -> DataFrame:
    """The nearest skills, those with a tag if one is given."""
    found = nearest(active(genes, category="skill"), query, most, most)
    return found.where(F.array_contains("dependencies", tag)) if tag else found


def by_name(genes: DataFrame, name: str, category: str, tenant: str) -> DataFrame:
    """The first active gene of a name and category; one row at most."""
    return active(genes, category=category).where((F.col("name") == name) & (F.col("tenant_id") == tenant)).orderBy("id").limit(1)


def install_skill(genes: DataFrame, name: str, description: str, prompt: str, tags: Sequence[str], tenant: str, as_of) -> DataFrame:
    """genes after a skill came: one of that name gets its text and a new version, else it is added at version 1."""
    known = by_name(genes, name, "skill", tenant).select(F.col("id").alias("_known"))
    now, listed = F.lit(as_of).cast("timestamp"), F.array(*map(F.lit, tags)).cast("array<string>")
    rows = genes.join(F.broadcast(known), F.col("id") == F.col("_known"), "left")  # one row at most
    hit = F.col("_known").isNotNull()
    made = {"description": F.lit(description), "solution": F.lit(prompt), "dependencies": listed, "version": F.col("version") + 1, "updated_at": now}
    kept = rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in made.items() if c in genes.columns}).select(*genes.columns)
    new = genes.sparkSession.range(1).select(
        F.sha2(F.concat_ws("|", F.lit(name), F.lit("skill"), F.lit(tenant)), 256).alias("id"), F.lit(name).alias("name"), F.lit(description).alias("description"), F.lit(prompt).alias("solution"), F.lit("skill").alias("category"),
        listed.alias("dependencies"), F.lit(0.70).alias("confidence"), F.lit(1).cast("long").alias("version"), F.lit("active").alias("status"), F.lit(tenant).alias("tenant_id"), now.alias("created_at"), now.alias("updated_at"),
    )
    new = new.join(known, F.lit(True), "left_anti")
    return kept.unionByName(new.select(*[c for c in new.columns if c in genes.columns]), allowMissingColumns=True)


def upsert_genes(genes: DataFrame, batch: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(genes, mutations): a gene of known name, project and tenant gets a new version and a mutation row, others are inserted at version 1. Of rows of the batch with one key, the first by problem and solution counts."""
    old = genes.select(*GENE_KEY, F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("evolution_score").alias("_score"), F.col("usage_count").alias("_usage"), F.col("created_at").alias("_created"))
    both = keep_first(batch, GENE_KEY, "problem", "solution").join(old, list(GENE_KEY), "left")
    known = F.col("_id").isNotNull()
    now = F.lit(as_of).cast("timestamp")
    made = both.withColumns(
        {
            "id": F.coalesce("_id", F.sha2(F.concat_ws("|", *GENE_KEY), 256)),
            "version": F.when(known, F.col("_version") + 1).otherwise(1).cast("long"),
            "evolution_score": F.when(known, F.coalesce("_score", F.lit(0)) + 1).otherwise(0).cast("long"),
            "usage_count": F.coalesce("_usage", F.lit(0)).cast("long"),
            "status": F.lit("active"),
            "created_at": F.coalesce("_created", now),
            "updated_at": now,
        }
    )
    changes = F.to_json(F.struct("problem", "solution"))
    mutations = made.where(known).select(F.sha2(F.concat_ws("|", "id", F.col("version").cast("string")), 256).alias("id"), F.col("id").alias("gene_id"), F.col("_version").alias("old_version"), F.col("version").alias("new_version"), changes.alias("changes"), now.alias("created_at"), "tenant_id")
    columns = [c for c in genes.columns if c in made.columns]
    kept = genes.join(made.select(*GENE_KEY), list(GENE_KEY), "left_anti")
    return kept.unionByName(made.select(*columns), allowMissingColumns=True), mutations


def first_line(text: Column) -> Column:
    return F.trim(F.split_part(text, F.lit("\n"), F.lit(1)))


def lines_from(text: Column, wanted: Column, more: int) -> Column:
    """The first line that meets wanted (a condition on x) and so many after it, or null."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, wanted), True)
    return F.when(at > 0, F.array_join(F.slice(lines, at.cast("int"), more + 1), "\n"))


def problem_of(text: Column) -> Column:
    found = lines_from(text, lambda x: F.contains(F.lower(x), F.lit("problem")) | F.startswith(x, F.lit("Task:")), 2)
    return F.coalesce(found, F.substring(text, 1, 200))


def solution_of(text: Column) -> Column:
    found = lines_from(text, lambda x: F.contains(F.lower(x), F.lit("solution")) | F.contains(F.lower(x), F.lit("fix")) | F.startswith(x, F.lit("Learnings:")), 4)
    return F.coalesce(found, F.substring(text, 1, 300))


def extract_genes(memories: DataFrame) -> DataFrame:
    """Drafts of genes from memories (id, content, memory_type, project, tenant_id)."""
    content, kind = F.col("content"), F.col("memory_type")
    return memories.select(
        F.coalesce(F.nullif(F.substring(first_line(content), 1, 80), F.lit("")), F.lit("Untitled Gene")).alias("name"),
        F.substring(content, 1, 300).alias("description"),
        problem_of(content).alias("problem"),
        solution_of(content).alias("solution"),
        F.when(kind == "MISTAKE", "immune").when(kind == "PATTERN", "pattern").otherwise("lesson").alias("category"),
        F.lit(0.5).alias("confidence"),
        F.lit("memory").alias("source_type"),
        F.col("id").alias("source_id"),
        "project",
        "tenant_id",
    )


def merge_genes(genes: DataFrame, chosen: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new gene, sources with status merged, relationships); nothing where fewer than two of the chosen are active."""
    rows = genes.where("status = 'active'").join(chosen.select("id").distinct(), "id", "left_semi")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", c))), lambda x: x[c]), "\n\n")
    made = rows.agg(F.avg("confidence").alias("confidence"), text("problem").alias("problem"), text("solution").alias("solution"), F.min("project").alias("project"), F.min("tenant_id").alias("tenant_id"), F.array_sort(F.collect_list("id")).alias("dependencies"))
    made = made.where(F.size("dependencies") >= 2).withColumns({"id": F.sha2(F.concat_ws("|", F.lit(name), F.array_join("dependencies", ",")), 256), "name": F.lit(name), "status": F.lit("active"), "version": F.lit(1).cast("long")})
    links = made.select(F.explode("dependencies").alias("source_id"), F.col("id").alias("target_id")).withColumns({"relationship": F.lit("merged_into"), "weight": F.lit(1.0)})
    merged = genes.join(links.select(F.col("source_id").alias("id")), "id", "left_semi").withColumn("status", F.lit("merged"))
    return made, merged, links


def split_genes(genes: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(children, relationships) of each gene: its solution's lines are dealt to 2 to 20 names in order; one that gets none takes a remark."""
    if not 2 <= len(names) <= 20:
        raise ValueError("a gene is split into 2 to 20")
    k = len(names)
    rows = genes.withColumn("_lines", F.filter(F.split(F.coalesce("solution", F.lit("")), "\n"), lambda x: F.trim(x) != "")).select("*", F.posexplode(F.array(*map(F.lit, names))).alias("_i", "_name"))
    n = F.size("_lines")
    a, b = F.floor(F.col("_i") * n / k), F.floor((F.col("_i") + 1) * n / k)
    part = F.array_join(F.slice("_lines", (a + 1).cast("int"), (b - a).cast("int")), "\n")
    made = rows.withColumns({"_parent": F.col("id"), "id": F.sha2(F.concat_ws("|", "id", "_name"), 256), "_old": F.col("name")}).withColumns(
        {"name": F.col("_name"), "solution": F.when(part != "", part).otherwise(F.concat(F.lit("Split from "), "_old")), "confidence": F.col("confidence") * 0.8, "status": F.lit("active"), "version": F.lit(1).cast("long")}
    )
    links = made.select(F.col("id").alias("source_id"), F.col("_parent").alias("target_id"), F.lit("split_from").alias("relationship"), F.lit(0.8).alias("weight"))
    return made.select(*genes.columns), links


def mutate(genes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """genes after outcomes (id, outcome: success or failure): confidence, success rate and version follow."""
    joined = genes.join(outcomes.select("id", "outcome"), "id", "left")
    c, sr, used = F.col("confidence"), F.coalesce("success_rate", F.lit(0.0)), F.coalesce("usage_count", F.lit(0))
    won, lost = F.col("outcome") == "success", F.col("outcome") == "failure"
    return joined.withColumns(
        {
            "confidence": F.when(won, F.least(F.lit(0.99), c + 0.05 * F.log2(2 + used))).when(lost, F.greatest(F.lit(0.05), 0.85 * c)).otherwise(c),
            "success_rate": F.when(won, (sr * used + 1) / (used + 1)).when(lost, sr * used / F.greatest(F.lit(1), used + 1)).otherwise(sr),
            "version": F.col("version") + F.when(won | lost, 1).otherwise(0),
        }
    ).drop("outcome")


def retire(genes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genes, one row of retired): those that weren't retired before count."""
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    joined = genes.join(hit, F.col("id") == F.col("_hit"), "left")
    changes = F.col("_hit").isNotNull() & (F.coalesce("status", F.lit("active")) != "retired")
    return joined.withColumn("status", F.when(changes, "retired").otherwise(F.col("status"))).drop("_hit"), joined.agg(F.coalesce(F.sum(changes.cast("long")), F.lit(0)).alias("retired"))


def immune_gene(failure: Column, prevention: Column) -> dict[str, Column]:
    return {
        "name": F.concat(F.lit("[IMMUNE] "), F.substring(failure, 1, 70)),
        "problem": F.concat(F.lit("Failure: "), F.substring(failure, 1, 500)),
        "solution": F.concat(F.lit("Prevention: "), F.substring(prevention, 1, 500)),
        "category": F.lit("immune"),
        "confidence": F.lit(0.7),
    }


def immune_context(found: DataFrame) -> DataFrame:
    """One row, context: warnings with their confidence in percent, the nearest first."""
    line = F.concat(F.lit("- "), "name", F.lit(" ("), F.format_string("%.0f", 100 * F.col("confidence")), F.lit("%): "), "solution")
    lines = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", line.alias("line"))))
    return found.agg(F.concat_ws("\n", F.lit("## Known failures"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("context"))


def skill_text() -> Column:
    """A gene as a Markdown skill."""
    head = F.concat(F.lit('---\nname: "'), "name", F.lit('"\ndescription: "'), F.coalesce("description", F.lit("")), F.lit('"\ncategory: "'), "category", F.lit('"\n---\n'))
    return F.concat(head, F.lit("\n## Problem\n"), F.coalesce("problem", F.lit("")), F.lit("\n\n## Solution\n"), F.coalesce("solution", F.lit("")), F.lit("\n"))


def generate_skills(genes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id and text of the skills made of genes with these ids, all genes after those were used once more)."""
    made = genes.join(ids.select("id").distinct(), "id", "left_semi").select("id", skill_text().alias("text"))
    return made, bump(genes, ids, "usage_count")


def inherit(genes: DataFrame, project: str, query: Sequence[float], limit: int, as_of) -> tuple[DataFrame, DataFrame]:
    """(genes, mutations) after a project took the nearest genes of others, a tenth less confident."""
    found = nearest(active(genes, not_project=project), query, limit)
    batch = found.withColumns({"source_id": F.col("id"), "source_type": F.lit("inherited"), "confidence": clamp(F.col("confidence") * 0.9), "project": F.lit(project)})
    return upsert_genes(genes, batch.drop("id", "version", "evolution_score", "usage_count", "status", "created_at", "updated_at", "score"), as_of)
