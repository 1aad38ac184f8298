"""Memories from session transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches, trim

# The separator and roles of a transcript, and the vocabularies of its rules.
SEPARATOR = "\n\n---\n\n"
MISTAKE = r"\b(mistake|error|fail|bug|wrong|broken|crash|exception|regression|incorrect)\b"
GRAVE = r"\b(critical|security|crash|data.loss|vulnerability)\b"
PREFERENCE = r"\b(prefer|like|want|would rather|style|convention|standard|best practice)\b"
PATTERN = r"\b(pattern|always|often|typically|recurring|whenever|common|standard way)\b"
FIX = r"\b(fix|refactor|optimize|improve|migrate|replace|upgrade)\b"
ENGINEERING = (
    r"\b(code|function|class|module|api|method|pattern|approach|architectur|solution|implement|use\s|because|reason|cause|root|fix|change|config|deploy|error|issue|problem|"
    r"prefer|better|worse|instead|recommend|learn|found|discover|notice|understand|see\s|need|should|must|require|support|handle|process|manag|build|create|design|structur|"
    r"dependenc|interface|service|component|system|framework|library|database|query|request|response|endpoint|route|middleware|schema|migrat|test|deploy|version|releas|update|"
    r"optimize|refactor)\b"
)


def memory_type(sentence: Column, role: Column) -> Column:
    """The type of the first rule that a lower-cased sentence meets, or null."""
    return (
        F.when(matches(sentence, MISTAKE), "MISTAKE")
        .when(matches(sentence, PREFERENCE), "PREFERENCE")
        .when(matches(sentence, PATTERN), "PATTERN")
        .when(matches(sentence, FIX), "KNOWLEDGE")
        .when((role == "ASSISTANT") & (F.length(sentence) > 120) & matches(sentence, ENGINEERING), "KNOWLEDGE")
    )


def importance(sentence: Column, kind: Column) -> Column:
    return (
        F.when(kind == "MISTAKE", F.when(matches(sentence, GRAVE), 8).otherwise(6))
        .when(kind.isin("PREFERENCE", "PATTERN"), 6)
        .when(matches(sentence, FIX), 5)
        .when(kind.isNotNull(), 4)
    )


def build(turns: DataFrame) -> DataFrame:
    """conv_id, transcript from rows of conv_id, turn, role, text; system turns are left out."""
    part = F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    rows = turns.where(F.col("role").isin("user", "assistant"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), SEPARATOR).alias("transcript"))


def sentences(transcripts: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, role, segment, place, sentence: those over 30 characters of segments of at least 30."""
    parts = transcripts.select(key, F.posexplode(F.split("transcript", SEPARATOR)).alias("segment", "part"))
    parts = parts.withColumn("role", F.regexp_extract("part", r"^\[(USER|ASSISTANT)\]", 1)).where("role <> ''")
    parts = parts.withColumn("body", trim(F.regexp_replace("part", r"^\[(USER|ASSISTANT)\]\n", ""))).where(F.length("body") >= 30)
    out = parts.select(key, "role", "segment", F.posexplode(F.split("body", r"[.!?]+")).alias("place", "sentence"))
    return out.withColumn("sentence", trim(F.col("sentence"))).where(F.length("sentence") > 30)


def classify(transcripts: DataFrame, key: str = "conv_id", top: int = 10) -> DataFrame:
    """key, rank, memory_type, content, importance: at most top memories of a transcript.

    Sentences with one beginning count once, among those that a rule takes. The
    most important come first, earlier ones before later; of those, one for each
    type and beginning.
    """
    lower = F.lower(F.col("sentence"))
    rows = sentences(transcripts, key).withColumn("memory_type", memory_type(lower, F.col("role"))).where("memory_type is not null")
    rows = rows.withColumn("importance", importance(lower, F.col("memory_type"))).withColumn("start", F.substring(lower, 1, 60))
    seen = Window.partitionBy(key, "start").orderBy("segment", "place")
    rows = rows.withColumn("_n", F.row_number().over(seen)).where("_n = 1").withColumn("content", F.substring("sentence", 1, 300))
    best = Window.partitionBy(key).orderBy(F.desc("importance"), "segment", "place")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    alike = Window.partitionBy(key, "memory_type", F.substring("content", 1, 40)).orderBy("rank")
    return rows.withColumn("_n", F.row_number().over(alike)).where("_n = 1").select(key, "rank", "memory_type", "content", "importance")


def small_talk(transcript: Column) -> Column:
    """Whether a transcript mentions what has a session load its context anew."""
    lower = F.lower(transcript)
    return F.contains(lower, F.lit("weather")) | F.contains(lower, F.lit("thanks")) | F.contains(lower, F.lit("sunny"))
