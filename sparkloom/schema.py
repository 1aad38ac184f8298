"""Tables of the memory store, and bringing frames to a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: DDL of each table; every one has a tenant.
TABLES = {
    "memories": "id string, session_id string, project string, provider string, memory_type string, content string, content_hash string, importance double, confidence double, embedding array<float>, status string, scope string, tags array<string>, related_ids array<string>, lifecycle_stage string, superseded_by string, evidence_count long, access_count long, version long, created_at timestamp, updated_at timestamp, last_accessed_at timestamp, tenant_id string",
    "genes": "id string, name string, description string, problem string, solution string, architecture string, category string, project string, confidence double, version long, evolution_score long, usage_count long, success_rate double, embedding array<float>, status string, source_type string, source_id string, dependencies array<string>, created_at timestamp, updated_at timestamp, tenant_id string",
    "gene_mutations": "id string, gene_id string, old_version long, new_version long, changes string, created_at timestamp, tenant_id string",
    "gene_relationships": "id string, source_id string, target_id string, relationship string, weight double, created_at timestamp, tenant_id string",
    "concepts": "id string, label string, description string, category string, embedding array<float>, project string, confidence double, source_ids array<string>, evidence_count long, access_count long, status string, created_at timestamp, updated_at timestamp, last_accessed_at timestamp, tenant_id string",
    "entities": "id string, project_name string, entity_type string, entity_name string, file_path string, content string, embedding array<float>, tenant_id string",
    "edges": "source_id string, target_id string, project_name string, relationship_type string, created_at timestamp, expires_at timestamp, tenant_id string",
    "episodes": "id string, project_name string, event_type string, event_data string, created_at timestamp, tenant_id string",
    "agents": "agent_id string, agent_url string, agent_name string, capabilities array<string>, status string, last_heartbeat timestamp, registered_at timestamp, metadata string, tenant_id string",
    "tasks": "id string, leader string, developer string, state string, description string, tool_name string, tool_params map<string,string>, artifacts array<struct<name:string,content:string>>, state_history array<struct<state:string,timestamp:timestamp,note:string>>, created_at timestamp, updated_at timestamp, tenant_id string",
    "activity": "uid string, key_id string, tool string, params string, success boolean, timestamp timestamp, tenant_id string",
}
#: What a missing or null value becomes where a table is brought to its schema.
DEFAULTS = {"status": "active", "evidence_count": 1, "access_count": 0, "version": 1, "confidence": 0.5, "usage_count": 0, "evolution_score": 0, "success_rate": 0.0}
#: Columns that identify a row, the tenant included.
KEYS = {"memories": ("project", "memory_type", "content_hash", "tenant_id"), "genes": ("name", "project", "tenant_id"), "entities": ("id",), "edges": ("source_id", "target_id", "project_name", "tenant_id"), "agents": ("agent_id",), "tasks": ("id",)}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def normalize(df: DataFrame, name: str, defaults: dict | None = None) -> DataFrame:
    """df with the table's columns, in order and cast; missing ones and, where the default isn't null, nulls take the default."""
    defaults = DEFAULTS if defaults is None else defaults
    have = {c.lower(): c for c in df.columns}
    out = []
    for field in schema(name).fields:
        value = F.col(f"`{have[field.name]}`").cast(field.dataType) if field.name in have else F.lit(None).cast(field.dataType)
        if defaults.get(field.name) is not None:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)


def ensure_tables(spark: SparkSession, folder: str) -> list[str]:
    """Writes an empty table, partitioned by tenant, for each that isn't in folder yet; returns their names. Safe to repeat."""
    jvm = spark.sparkContext._jvm
    made = []
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], schema(name)).write.partitionBy("tenant_id").parquet(f"{folder}/{name}")
            made.append(name)
    return made


def missing_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key is not null and not in parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
