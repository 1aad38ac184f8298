"""Frames that the queries work on, from the tables of a folder, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that queries take for now: 2024-03-01 00:00:00 UTC.
NOW_S = 1709251200
NOW = "2024-03-01 00:00:00"

#: Memories from vectors: expressions that both engines read.
MEMORY = """vec_id AS id, 't' || cast(vec_id % 2 AS string) AS tenant_id, 'p' || cast(label % 3 AS string) AS project,
 CASE label % 4 WHEN 0 THEN 'MISTAKE' WHEN 1 THEN 'PREFERENCE' WHEN 2 THEN 'PATTERN' ELSE 'KNOWLEDGE' END AS memory_type,
 0.3e0 + (vec_id % 7) * 0.1e0 AS confidence, 1 + vec_id % 9 AS importance, vec_id % 5 AS evidence_count, vec_id % 4 AS access_count,
 CASE WHEN vec_id % 3 = 0 THEN 'auth' WHEN vec_id % 3 = 1 THEN 'auth/login' ELSE 'db' END AS scope,
 CASE WHEN vec_id % 6 = 0 THEN NULL WHEN vec_id % 6 < 5 THEN 'active' ELSE 'archived' END AS status,
 1704067200 + vec_id * 3600 AS created_s, CASE WHEN vec_id % 2 = 0 THEN 1704067200 + vec_id * 4000 END AS accessed_s, embedding"""

#: Entities and edges from parts and their suppliers.
ENTITIES = """SELECT 'part:' || cast(p_partkey AS string) AS id, p_name AS entity_name, CASE p_partkey % 4 WHEN 0 THEN 'module' WHEN 1 THEN 'class' WHEN 2 THEN 'function' ELSE 'variable' END AS entity_type,
 'src/' || p_brand || '/' || cast(p_size AS string) || '.ts' AS file_path, 't' AS tenant_id FROM part"""
EDGES = "SELECT DISTINCT 'supp:' || cast(l_suppkey AS string) AS source_id, 'part:' || cast(l_partkey AS string) AS target_id, 'call' AS relationship_type, 't' AS tenant_id FROM lineitem"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").selectExpr(*split_expressions(MEMORY))
    return rows.withColumns({"created_at": F.timestamp_seconds("created_s"), "last_accessed_at": F.timestamp_seconds("accessed_s")})


def split_expressions(text: str) -> list[str]:
    """Cuts a select list at commas outside parentheses."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def select(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in tables}) if "{" in sql else _with_views(spark, sf_dir, sql, tables)


def _with_views(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    import re

    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in tables})


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, ENTITIES, "part")


#: Rows that one task makes distinct (100 MB).
TASK_ROWS = 500_000


def distinct_by(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of columns. Rows are dealt by them to tasks of about TASK_ROWS rows before any are held, so that a task's table doesn't grow with the splits of the input."""
    n = max(1, -(-rows.count() // TASK_ROWS))
    return rows.select(*columns).repartition(n, *columns).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDGES, whose numbers are made distinct before they become texts."""
    pairs = distinct_by(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    return pairs.selectExpr("'supp:' || cast(l_suppkey AS string) AS source_id", "'part:' || cast(l_partkey AS string) AS target_id", "'call' AS relationship_type", "'t' AS tenant_id")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest vec_id: what searches look for."""
    return read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]
