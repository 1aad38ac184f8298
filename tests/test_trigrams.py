"""Searches by parts of texts through the index against scans."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import trigrams

TEXTS = ["Red green BLUE", "green", "re", "", None, "a red herring", "ÄÖÜ straße", "redredred", "x" * 500 + "Needle", "tab\tand\nline", "100% [a.b]*", "blue red"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    many = TEXTS + [f"common text number {i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(many)), "id long, t string")
    return df, trigrams.build_text_index(df, str(tmp_path_factory.mktemp("texts")), "id", F.col("t"), buckets=16)


@pytest.mark.parametrize("term", ["red", "RED", "re", "r", "", "reen b", "needle", "öü", "äöü ", "common text number 29", "nowhere", "edr", "\tand\nl", "% [a.b]*", "rednothing"])
def test_same_rows_as_a_scan(spark, index, term):
    df, made = index
    found = sorted(r[0] for r in trigrams.search_text(made, spark, term).collect())
    assert found == sorted(r[0] for r in df.where(F.contains(F.lower("t"), F.lit(term.lower()))).collect())


def test_only_the_buckets_that_are_needed(spark, index):
    _, made = index
    plan = trigrams.candidates(made, spark, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan.replace("Or(", "In(")
    verify = trigrams.search_text(made, spark, "needle")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in verify or "PartitionFilters: [(part" in verify or "PartitionFilters: [part" in verify


def test_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id long, t string")
    made = trigrams.build_text_index(df, str(tmp_path / "n"), "id", F.col("t"))
    assert [trigrams.search_text(made, spark, t).collect() for t in ("abc", "ab", "")] == [[], [], []]


def test_a_gram_of_a_stretch_of_texts_is_one_row(spark, tmp_path, monkeypatch):
    texts = [f"common {i}" for i in range(300)] + ["a\U0001f600b\U0001f600" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    made = trigrams.build_text_index(df, str(tmp_path / "one"), "id", F.col("t"), buckets=1)
    rows = made.table(spark, "lists").where("gram = 'omm'").collect()
    assert len(rows) == 1 and sorted(rows[0]["keys"]) == list(range(300))
    assert [r["key"] for r in trigrams.search_text(made, spark, "\U0001f600B\U0001f600a").collect()] == [300]
    monkeypatch.setattr(trigrams, "TASK_ROWS", 40)
    many = trigrams.build_text_index(df, str(tmp_path / "many"), "id", F.col("t"), buckets=1)
    assert len(many.table(spark, "lists").inputFiles()) > 1
    assert sorted(r["key"] for r in trigrams.search_text(many, spark, "COMMON 29").collect()) == [29, *range(290, 300)]
