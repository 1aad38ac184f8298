"""Rules over code graphs that find likely vulnerabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifier_words
from .filters import is_test_path

# The words of the rules.
SECRET = ("secret", "password", "token", "credential", "bearer", "apikey")
KEY_BESIDE = ("api", "private", "access", "secret", "encryption", "decryption", "auth", "session")
NO_SECRET = "expired count length type url path status valid error failed success check verify duration limit payload header name id store storage service provider client".split()
UNSAFE = ("eval", "exec", "system", "child_process", "spawn", "shell_exec")
DATABASE = ("db", "database", "repository", "model", "oracle", "postgres", "mysql", "sqlite", "sql", "connection", "pool", "transaction")


def is_secret_name(name: Column) -> Column:
    """A secret word, or key beside a word that makes it one; any metadata word vetoes."""
    words = identifier_words(name)
    beside = lambda i: F.coalesce(F.get(words, i).isin(*KEY_BESIDE), F.lit(False))
    keys = F.transform(words, lambda w, i: (w == "key") & (F.when(i > 0, beside(i - 1)).otherwise(F.lit(False)) | beside(i + 1)))
    found = F.exists(words, lambda w: w.isin(*SECRET)) | F.exists(keys, lambda k: k)
    return found & ~F.exists(words, lambda w: w.isin(*NO_SECRET))


def mentions_database(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(lower, F.lit(k)) for k in DATABASE))


def findings(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """severity, type, message, filePath, line and node id, of nodes (id, type, label, filePath, line) and links (source, target).

    Only functions named like queries look at their neighbours, so that the join
    with the graph takes few rows. Nodes of tests are left out.
    """
    own = nodes.where(~is_test_path(F.coalesce("filePath", F.lit(""))))
    where = [F.coalesce("filePath", F.lit("unknown")).alias("filePath"), "line", "id"]

    def made(df: DataFrame, severity: str, kind: str, before: str, after: str = "") -> DataFrame:
        return df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.concat(F.lit(before), "label", F.lit(after)).alias("message"), *where)

    secrets = own.where((F.col("type") == "variable") & is_secret_name(F.col("label")))
    functions = own.where(F.col("type") == "function")
    unsafe = functions.where(F.lower("label").isin(*UNSAFE))
    named = functions.where((F.contains("label", F.lit("Query")) | F.contains("label", F.lit("execute"))) & (F.col("label") != "execute") & ~F.endswith("label", F.lit("UseCase")))
    direct = mentions_database(F.col("filePath")) | mentions_database(F.col("label"))
    database = nodes.where(mentions_database(F.col("label")) | mentions_database(F.col("filePath"))).select(F.col("id").alias("v"))
    ends = links.select(F.col("source").alias("u"), F.col("target").alias("v")).union(links.select(F.col("target").alias("u"), F.col("source").alias("v")))
    near = ends.join(database, "v", "left_semi").select(F.col("u").alias("id")).distinct().withColumn("_near", F.lit(True))
    sql = named.join(near, "id", "left").where(direct | F.coalesce("_near", F.lit(False)))
    return (
        made(secrets, "HIGH", "HARDCODED_SECRET", "Potential hardcoded secret found in variable: ")
        .union(made(unsafe, "CRITICAL", "UNSAFE_FUNCTION", "Use of potentially dangerous function: "))
        .union(made(sql, "MEDIUM", "SQL_INJECTION_RISK", "Potential SQL Injection risk in database call: ", ". Ensure parameterized queries are used."))
    )
