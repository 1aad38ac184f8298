"""The corpus pipeline: quality, near duplicates, contamination, personal data, tokens.

Each stage takes all rows that the one before it kept and returns documents with
their own columns; the last returns tokens. run() writes each stage's result to
the shared folder and reads it back, so that a lost executor costs one stage's
tasks and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._shared import table, written
from sparkloom.llm.bpe import default_tokenizer, encode_decode
from sparkloom.llm.decontam import contamination
from sparkloom.llm.jaccard import jaccard_components
from sparkloom.llm.pii import find_pii
from sparkloom.llm.quality import THRESHOLD, train, with_statistics
from sparkloom.ship import ship


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and _row with all columns, so that no column's name meets one that an operator uses inside."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores at the threshold or above. It learns from the labelled ones outside the held-out quarter.

    Null and empty texts are scored by their zeros, repeated rows alike; a score
    at the threshold stays. Without labels or rows the score is a constant, and
    an empty table gives an empty one.
    """
    ship(spark)
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return with_statistics(_boxed(docs), "_row").where(model.score() >= THRESHOLD).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Rows without an id or without words stay, and so do repeated rows of an id
    that stays. An empty table gives an empty one.
    """
    ship(spark)
    found = jaccard_components(docs.select("doc_id", "text")).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of a benchmark item.

    Rows that share id and text go or stay together, with null ids as well; null
    and empty texts stay. An empty table or benchmark drops nothing.
    """
    ship(spark)
    rows = _boxed(docs).withColumn("_text_hash", F.xxhash64("text"))
    hit = contamination(rows, table(spark, sf_dir, "benchmark", "item_id", "text"), "doc_id", "_text_hash").where("contaminated").select("doc_id", "_text_hash").distinct()
    hit = hit.select(F.col("doc_id").alias("_hit_id"), F.col("_text_hash").alias("_hit_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & F.col("_text_hash").eqNullSafe(F.col("_hit_hash"))
    return rows.join(hit, same, "left_anti").select("_row.*")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind's name in brackets for each span of personal data; n_chars follows the new text. All rows stay, null texts stay null."""
    ship(spark)
    rows = find_pii(_boxed(docs), "_row", fields=("redacted",))
    text = F.when(F.col("_row.text").isNotNull(), F.col("redacted"))
    made = {"text": text, "n_chars": F.when(F.col("_row.n_chars").isNotNull(), F.coalesce(F.length(text), F.lit(0)).cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*(made[c].alias(c) if c in made else F.col(f"_row.`{c}`") for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, one row a row; a null text counts as empty."""
    ship(spark)
    return encode_decode(docs.select("doc_id", "text"), default_tokenizer(), keep=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training a classifier isn't SQL; tests/llm check the stages by brute force.
ORACLE_SQL = None
