"""Sources and sinks: tables, source trees, session logs, analysis documents, Markdown."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim

# What is indexed and what never is.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "go", "php", "phtml", "ctp", "rs", "java", "rb", "swift", "kt")
EXCLUDED = ("node_modules", ".git", "dist", "out", "build", "__pycache__", ".cache", "venv", ".venv")
MOST_BYTES = 500_000
#: The folder that analyses are kept in, beside the code; it is never indexed, and marks a project.
ANALYSIS_FOLDER = ".analysis"

ANALYSIS = (
    "graph struct<nodes:array<struct<id:string,label:string,type:string,filePath:string,line:long,color:string>>,links:array<struct<source:string,target:string,type:string>>>, insights array<string>, entityCounts map<string,long>, totalFilesAnalyzed long, totalFilesSkipped long"
)


def query(spark: SparkSession, sql: str, args: dict | list | None = None, **views: DataFrame) -> DataFrame:
    """A SELECT or WITH over the views, with bound parameters (:name or ?); anything else is refused."""
    if not re.match(r"\s*(with|select)\b", sql, re.IGNORECASE):
        raise ValueError("only queries are run; write through the sinks")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of another store; give partitionColumn, bounds and numPartitions for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def ignore_regex(pattern: str) -> str | None:
    """A path expression for an ignore line: *, ?, **/, a leading / (anchored) and a trailing / (folders); None for negations and comments."""
    pattern = pattern.strip().replace("\\", "/")
    if not pattern or pattern[0] in "!#":
        return None
    folder, body = pattern.endswith("/"), pattern.removesuffix("/")
    made = "".join({"**/": "(?:.+/)?", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*/|.", body.lstrip("/")))
    if body.startswith("/"):
        return f"^{made}(?:/|$)"
    if "/" in body:
        return f"^{made}"
    return f"(?:^|/){made}/" if folder else f"(?:^|/){made}(?:/|$)"


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns takes a path; folders end in / themselves."""
    found = [r for p in patterns if (r := ignore_regex(p))]
    return path.rlike("|".join(f"(?:{r})" for r in found)) if found else F.lit(False)


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """The lines of one ignore file, without comments: a small file, read whole."""
    rows = spark.read.text(path).select(trim(F.col("value")).alias("p")).where("p <> '' and not startswith(p, '#')")
    return [r["p"] for r in rows.collect()]


def source_tree(spark: SparkSession, folder: str, patterns: Sequence[str] = ()) -> DataFrame:
    """path (from folder) and content of the source files below folder: known extensions in any case, 1 to MOST_BYTES bytes, nothing excluded or ignored."""
    any_case = ["".join(f"[{c}{c.upper()}]" for c in x) for x in EXTENSIONS]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{%s}" % ",".join(any_case)).load(folder)
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.substring_index(F.col("path"), f"{root}/", -1)
    rows = files.where((F.col("length") > 0) & (F.col("length") < MOST_BYTES)).select(path.alias("path"), F.col("content").cast("string").alias("content"))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, (*EXCLUDED, ANALYSIS_FOLDER)))) & ~ignored(F.col("path"), patterns))


SESSION_FILE = r"/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.jsonl$"
LINE = "type string, isMeta boolean, message string"


def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, session_id, length of session logs: named by a UUID, over 100 bytes, not of subagents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder).select("path", "length")
    rows = files.where(F.col("path").rlike(SESSION_FILE) & ~F.contains("path", F.lit("/subagents/")) & (F.col("length") > 100))
    return rows.withColumn("session_id", F.regexp_extract("path", r"/([^/]+)\.jsonl$", 1))


def unprocessed(sessions: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    return sessions if force else sessions.join(done.select("session_id"), "session_id", "left_anti")


def session_transcripts(lines: DataFrame) -> DataFrame:
    """session_id, transcript from log lines (session_id, n, value); lines that can't be read, meta, mode and system lines, commands and short texts are skipped."""
    from ..operators.transcripts import SEPARATOR

    row = F.from_json("value", LINE)
    parsed = lines.select("session_id", "n", row.alias("j")).where("j is not null and not coalesce(j.isMeta, false) and j.type in ('user', 'assistant')")
    content = F.get_json_object("j.message", "$.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    text = F.when(F.startswith(content, F.lit("[")), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(content)
    said = parsed.select("session_id", "n", F.upper("j.type").alias("role"), trim(text).alias("text")).where((F.length("text") >= 20) & ~(F.contains("text", F.lit("<command-")) & (F.col("role") == "USER")))
    part = F.concat(F.lit("["), "role", F.lit("]\n"), "text")
    return said.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"]), SEPARATOR).alias("transcript"))


def session_lines(spark: SparkSession, sessions: DataFrame) -> DataFrame:
    """session_id, n, value of the logs in sessions (path, session_id), whose names are listed on the driver."""
    paths = [r["path"] for r in sessions.select("path").collect()]
    schema = "session_id string, n long, value string"
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.format("binaryFile").load(paths)
    cut = rows.select(F.regexp_extract("path", r"/([^/]+)\.jsonl$", 1).alias("session_id"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("n", "value"))
    return cut.select("session_id", F.col("n").cast("long"), "value").where("value <> ''")


def markdown_genes(spark: SparkSession, folder: str) -> DataFrame:
    """name, description, category and text of Markdown files with front matter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    text = F.col("content").cast("string")
    field = lambda name: F.nullif(F.regexp_extract(text, f'(?m)^{name}: "?(.+?)"?$', 1), F.lit(""))
    return files.select(F.regexp_extract("path", r"/([^/]+)\.md$", 1).alias("name"), field("description").alias("description"), field("category").alias("category"), text.alias("text"))


def write_markdown(df: DataFrame, folder: str) -> None:
    """Markdown of each gene below folder/name=<name>: partitions of a text table, which any store of Spark's takes. Names that are there stay as they are."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    rows = df.select("name", "text").dropDuplicates(["name"])
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        known = spark.read.schema("text string, name string").text(folder, wholetext=True).select("name")
        rows = rows.join(known.distinct(), "name", "left_anti")
    rows.write.partitionBy("name").mode("append").text(folder)


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """Analysis documents; none where there is no file."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ANALYSIS)
    return spark.read.schema(ANALYSIS).option("multiLine", True).json(path)


def analysis_parts(analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of analysis documents."""
    return analysis.select(F.explode("graph.nodes").alias("n")).select("n.*"), analysis.select(F.explode("graph.links").alias("l")).select("l.*")


def write_analysis(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """Nodes and links as JSON tables, in parts."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    links.write.mode("overwrite").json(f"{path}/links")


def write_snapshot(df: DataFrame, path: str, *partitions: str) -> None:
    """Replaces a table: the new one is written beside it and then takes its name, so that a plan may read what it replaces."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, now, old = (jvm.org.apache.hadoop.fs.Path(f"{path}{x}") for x in ("__new", "", "__old"))
    store = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}__new")
    if store.exists(now):
        store.rename(now, old)
    store.rename(new, now)
    store.delete(old, True)


def migrate(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with the rows of source, on the columns that both have; equal keys are replaced."""
    from ..operators.memory import upsert

    both = [c for c in target.columns if c in source.columns]
    return upsert(target, source.select(*both), keys).select(*target.columns)


# Folders that are no projects themselves, files that make an analysis folder a project's, and what editors' own folders hold.
NO_PROJECTS = ("/", "/config")
ANALYSIS_FILES = ("analysis.json", "settings.json")
EDITOR_FOLDERS = ("resources/app/extensions", "resources/app/out/vs")


def project_dirs(listing: DataFrame, analysis_folder: str = ANALYSIS_FOLDER, home: str | None = None) -> DataFrame:
    """name, dir, modified_at of project folders among (dir, child, modified_at), child being a path from dir, the latest first.

    A project has .git, or an analysis folder with one of ANALYSIS_FILES. Left out
    are the root, home and other folders above projects, editors' own folders, and
    whatever lies in a hidden folder other than an analysis folder.
    """
    marks = [".git", *(f"{analysis_folder}/{f}" for f in ANALYSIS_FILES)]
    parts = F.filter(F.split("dir", "/"), lambda p: p.startswith(".") & ~p.startswith("..") & (p != analysis_folder))
    above = [*NO_PROJECTS, *([home.rstrip("/")] if home else [])]
    rows = listing.where((F.size(parts) == 0) & ~F.col("dir").isin(above))
    editor = F.lit(False)
    for folder in EDITOR_FOLDERS:
        editor = editor | (F.col("child") == folder) | F.startswith("child", F.lit(f"{folder}/"))
    rows = rows.groupBy("dir").agg(F.max(F.col("child").isin(marks)).alias("is_project"), F.max(editor).alias("is_editor"), F.max("modified_at").alias("modified_at"))
    return rows.where("is_project and not is_editor").select(F.regexp_extract("dir", r"([^/]+)/?$", 1).alias("name"), "dir", "modified_at").orderBy(F.desc("modified_at"), "dir")


def resolve_project(projects: DataFrame, wanted: str) -> DataFrame:
    """The project that a path, a name in any case or a relative path means; one row at most."""
    found = (F.col("dir") == wanted) | (F.lower("name") == wanted.lower()) | F.endswith("dir", F.lit(f"/{wanted.strip('/')}"))
    return projects.where(found).orderBy("dir").limit(1)
