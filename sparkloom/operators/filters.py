"""Predicates and small relational steps over memories, graphs and registries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of a tenant; none without one."""
    return df.where(F.col("tenant_id") == F.lit(tenant)) if tenant else df.where(F.lit(False))


def in_scope(scope: Column, wanted: str) -> Column:
    return (scope == wanted) | scope.startswith(f"{wanted}/")


def _moment(value) -> datetime | None:
    try:
        return datetime.fromisoformat(value) if isinstance(value, str) else value
    except ValueError:
        return None


def memory_filters(
    df: DataFrame, *, project: str | None = None, provider: str | None = None, after=None, before=None, scope: str | None = None, tags: Sequence[str] = (), types: str | Sequence[str] | None = None, ids: DataFrame | None = None, with_status: bool = True
) -> DataFrame:
    """Optional filters, all of which must hold; dates that can't be read are ignored, types may be a comma list."""
    for name, value in (("project", project), ("provider", provider)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if (moment := _moment(after)) is not None:
        df = df.where(F.col("created_at") >= F.lit(moment))
    if (moment := _moment(before)) is not None:
        df = df.where(F.col("created_at") <= F.lit(moment))
    if scope:
        df = df.where(in_scope(F.col("scope"), scope))
    if tags:
        df = df.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if types:
        wanted = [t.strip().upper() for t in (types.split(",") if isinstance(types, str) else types) if t.strip()]
        df = df.where(F.col("memory_type").isin(wanted))
    if with_status:
        df = df.where(F.col("status").isNull() | F.col("status").isin("active", "superseded"))
    return df if ids is None else df.join(ids, "id", "left_semi")


#: Folders of third-party code, by mode.
VENDOR = {"substring": r"node_modules|venv|\.venv|site-packages", "path": r"(^|/)(node_modules|venv|\.venv|site-packages)(/|$)", "trace": r"(^|/)(node_modules|venv|\.venv|site-packages|vendor)(/|$)"}


def own_code(path: Column, node_id: Column | None = None, mode: str = "path") -> Column:
    """Not of a vendor's folder, nor (by id) external."""
    own = ~F.coalesce(F.regexp_replace(path, r"\\", "/").rlike(VENDOR[mode]), F.lit(False))
    return own if node_id is None else own & ~node_id.startswith("external:")


def contains_any_case(text: Column, wanted: str) -> Column:
    return F.instr(F.lower(text), wanted.lower()) > 0


def path_text(path: Column, node_id: Column) -> Column:
    """What searches by path look into: the path, or the id where there is none, with slashes."""
    return F.regexp_replace(F.coalesce(path, node_id), r"\\", "/")


def path_matches(path: Column, node_id: Column, wanted: str) -> Column:
    return F.contains(F.lower(path_text(path, node_id)), F.lit(wanted.replace("\\", "/").lower()))


# Parts of paths that mark tests and the like.
TEST_PATHS = ("/tests/", "/test/", "/__tests__/", ".test.", ".spec.", "/mocks/", "/mock/", "/scratch/", "/diagnostic/")


def is_test_path(path: Column) -> Column:
    lower = F.lower(F.regexp_replace(path, r"\\", "/"))
    found = F.lit(False)
    for part in TEST_PATHS:
        found = found | F.contains(lower, F.lit(part))
    return F.coalesce(found, F.lit(False))


def task_search(df: DataFrame, text: str | None, state: str | None) -> DataFrame:
    if text:
        found = F.lit(False)
        for name in ("id", "description", "leader", "developer"):
            found = found | F.coalesce(contains_any_case(F.col(name), text), F.lit(False))
        df = df.where(found)
    return df.where(F.col("state") == state) if state else df


def has_capability(capabilities: Column, wanted: str) -> Column:
    return F.coalesce(F.exists(capabilities, lambda c: F.contains(F.lower(c), F.lit(wanted.lower()))), F.lit(False))


def discover_agents(df: DataFrame, tenant: str, status: str | None = "online", capability: str | None = None, most: int = 50) -> DataFrame:
    df = scoped(df, tenant)
    df = df.where(F.col("status") == status) if status else df
    df = df.where(has_capability(F.col("capabilities"), capability)) if capability else df
    return df.orderBy(F.when(F.col("status") == "online", 0).otherwise(1), "agent_id").limit(most)


def merged_agents(*sources: DataFrame) -> DataFrame:
    """Agents of several sources; of equal urls the one from the earliest source."""
    both = None
    for n, df in enumerate(sources):
        df = df.withColumn("_source", F.lit(n))
        both = df if both is None else both.unionByName(df, allowMissingColumns=True)
    first = Window.partitionBy("agent_url").orderBy("_source", "agent_id")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_source")


def enabled_tools(tools: DataFrame, disabled: DataFrame, protected: Sequence[str]) -> DataFrame:
    """tool names without the disabled ones; protected ones can't be disabled."""
    return tools.join(disabled.where(~F.col("tool").isin(list(protected))), "tool", "left_anti")


def keep_first(df: DataFrame, keys: Sequence[str], *order, most: int = 1) -> DataFrame:
    """The first row, or rows, of each key. Spark cuts each key's rows to as many before they move."""
    n = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(n)).where(F.col("_n") <= most).drop("_n")


def page(df: DataFrame, limit: int, offset: int = 0, *order, most: int = 100) -> DataFrame:
    """Rows offset.. of the order; limit is held to 1..most."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def categories(df: DataFrame, column: str = "category") -> DataFrame:
    """The distinct values there are to filter by."""
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def activity(requests: DataFrame, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Each user's requests and the second of the last one."""
    return requests.groupBy(key).agg(F.count("*").alias("requests"), F.unix_seconds(F.max(at).cast("timestamp")).alias("last_s"))


def truncated(df: DataFrame, most: int, *order) -> tuple[DataFrame, DataFrame]:
    """The first most rows, and one row of total, showing and truncated."""
    info = df.agg(F.count("*").alias("total")).select("total", F.least("total", F.lit(most)).alias("showing"), (F.col("total") > most).alias("truncated"))
    return df.orderBy(*order).limit(most), info
