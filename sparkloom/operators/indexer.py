"""Nodes and links of source code, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by extension (in any case), and the colours of modules by extension, of classes, functions and other modules.
LANGUAGES = {"ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "py": "py", "go": "go", "php": "php", "phtml": "php", "ctp": "php"}
NOT_CALLS = ("if", "while", "for", "switch", "catch", "then", "return", "throw", "console", "typeof")
COLOURS = {
    "ts": "#3178c6", "tsx": "#3178c6",
    "js": "#f7df1e", "jsx": "#f7df1e",
    "py": "#3776ab", "go": "#00add8",
    "php": "#777bb4", "rs": "#dea584",
    "java": "#b07219", "rb": "#cc342d",
    "swift": "#f05138", "kt": "#7f52ff",
}
CLASS_COLOUR, FUNCTION_COLOUR, OTHER_COLOUR = "#ffb74d", "#81c784", "#94a3b8"

# Patterns of classes and of functions by language (the name is the first group), and of imports.
RULES = {
    "ts": (r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\("),
    "py": (r"^\s*class\s+(\w+)", r"^\s*def\s+(\w+)\s*\("),
    "go": (r"^\s*type\s+(\w+)\s+struct", r"^\s*func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\("),
    "php": (r"(?i)^\s*(?:abstract\s+)?class\s+(\w+)", r"(?i)^\s*(?:public|private|protected|static)?\s*function\s+(\w+)\s*\("),
}
TS_IMPORT = r"""import\s+(?:\{[^}]*\}\s+from\s+)?["']([^"']+)["']|from\s+["']([^"']+)["']"""
PY_IMPORT = r"(?:from\s+(\S+)\s+)?import\s+(.+)"


def by_language(language: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in values.items():
        out = F.when(language == name, value).otherwise(out)
    return out


def resolve_import(path: Column, target: Column) -> Column:
    """The module a relative import means: folders joined, dots and parents taken away, .ts at the end; other targets flattened."""
    folder = F.regexp_replace(path, r"(^|/)[^/]*$", "")
    parts = F.split(F.concat_ws("/", folder, target), "/")
    walked = F.aggregate(
        parts,
        F.lit([]).cast("array<string>"),
        lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(F.when(F.startswith(target, F.lit(".")), F.array_join(walked, "/")).otherwise(F.regexp_replace(target, "[/.]", "_")), F.lit(".ts"))


def of_extension(path: Column, values: dict[str, str]) -> Column:
    """What a path's extension stands for, in any case; null for others."""
    known = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def lines_of(files: DataFrame) -> DataFrame:
    """path, module, language, line, text of rows of path and content."""
    rows = files.withColumn("language", of_extension(F.col("path"), LANGUAGES)).withColumn("module", F.concat(F.lit("module:"), "path"))
    return rows.select("path", "module", "language", F.posexplode(F.split("content", "\n")).alias("at", "text")).withColumn("line", F.col("at") + 1).drop("at")


def index(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of files (path, content): a module for each file, labelled by its path and coloured by its extension, its classes and functions, and import, contains and call links.

    Lines are matched independently, so that a large file is many rows. Calls
    point into their own file, and a definition also reads as a call.
    """
    lines = lines_of(files)
    language = F.col("language")
    name = lambda n: by_language(language, {k: F.regexp_extract("text", r[n], 1) for k, r in RULES.items()})
    found = lines.withColumn("cls", name(0)).withColumn("fn", name(1))
    found = found.withColumn("fn", F.when((language == "py") & (F.col("fn") == "__init__"), "").when((language == "go") & ~F.col("fn").rlike("^[A-Z]"), "").otherwise(F.col("fn")))
    one = lambda kind, column, colour: F.struct(F.lit(kind).alias("type"), F.col(column).alias("label"), F.lit(colour).alias("color"))
    defined = found.select("path", "module", "line", F.explode(F.array(one("class", "cls", CLASS_COLOUR), one("function", "fn", FUNCTION_COLOUR))).alias("d")).where("d.label <> ''")
    defined = defined.select(F.concat_ws(":", "d.type", "module", "d.label").alias("id"), "d.label", "d.type", F.col("path").alias("filePath"), "line", "d.color", "module")
    modules = files.select(F.concat(F.lit("module:"), "path").alias("id"), F.col("path").alias("label"), F.lit("module").alias("type"), F.col("path").alias("filePath"), F.lit(1).alias("line"), F.coalesce(of_extension(F.col("path"), COLOURS), F.lit(OTHER_COLOUR)).alias("color"))
    nodes = modules.unionByName(defined.drop("module"))
    contains = defined.select(F.col("module").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"))
    called = lines.where("language = 'ts'").select("path", "module", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)\("), F.lit(1))).alias("name")).where(~F.col("name").isin(*NOT_CALLS))
    calls = called.select(F.col("module").alias("source"), F.concat(F.lit("function:module:"), "path", F.lit(":"), "name").alias("target"), F.lit("call").alias("type"))
    ts = F.coalesce(F.nullif(F.regexp_extract("text", TS_IMPORT, 1), F.lit("")), F.regexp_extract("text", TS_IMPORT, 2))
    py = F.coalesce(F.nullif(F.regexp_extract("text", PY_IMPORT, 1), F.lit("")), F.trim(F.split_part(F.regexp_extract("text", PY_IMPORT, 2), F.lit(","), F.lit(1))))
    targets = lines.select("path", "module", "language", by_language(language, {"ts": ts, "py": py}).alias("to"))
    targets = targets.where(F.startswith("to", F.lit(".")) | ((language == "ts") & F.startswith("to", F.lit("/"))))
    to = F.when(language == "py", F.replace("to", F.lit("."), F.lit("/"))).otherwise(F.col("to"))
    imports = targets.select(F.col("module").alias("source"), F.concat(F.lit("module:"), resolve_import(F.col("path"), to)).alias("target"), F.lit("import").alias("type"))
    return nodes, contains.unionByName(calls).unionByName(imports)


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def coverage(analyzed: Column, skipped: Column) -> Column:
    """Percent of files that were analysed; all, where there are none."""
    total = analyzed + skipped
    return F.when(total == 0, 100).otherwise(F.round(100 * analyzed / F.when(total != 0, total)).cast("int"))
