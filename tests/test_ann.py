"""The vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ann, memory


def _rows(spark, vectors):
    return spark.createDataFrame([(f"k{i:05d}", i % 3, [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, part int, embedding array<float>")


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 24))
    vectors = np.concatenate([centres[r.integers(0, 40, 3_000)] + 0.25 * r.normal(size=(3_000, 24)), np.repeat(centres[:1], 1_500, axis=0)])  # a third is one vector
    df = _rows(spark, vectors).unionByName(spark.createDataFrame([("null", 0, None), ("empty", 0, []), ("zero", 0, [0.0] * 24), ("short", 0, [1.0])], "id string, part int, embedding array<float>"))
    path = str(tmp_path_factory.mktemp("index"))
    ann.build_index(df, path)
    return df, vectors, ann.open_index(spark, path)


def _exact(vectors, query, k, keep=None):
    u = vectors.astype(np.float32).astype(float)
    score = u @ query / np.linalg.norm(u, axis=1) / np.linalg.norm(query)
    order = [i for i in np.lexsort((np.arange(len(u)), -np.round(score, 9))) if keep is None or keep(i)]
    return [f"k{i:05d}" for i in order[:k]]


def test_all_cells_are_exact(spark, clustered):
    df, vectors, index = clustered
    for i in (7, 50, 999):
        query = vectors[i].astype(np.float32).astype(float)
        got = [r["id"] for r in ann.search(index, spark, query, 10, probes=len(index.centroids)).collect()]
        assert got == _exact(vectors, query, 10)
    got = [r["id"] for r in ann.search(index, spark, query, 5, len(index.centroids), F.col("part") == 1).collect()]
    assert got == _exact(vectors, query, 5, lambda i: i % 3 == 1)
    assert index.rows(spark).count() == len(vectors)  # without the odd ones


def test_recall_and_pruning(spark, clustered):
    df, vectors, index = clustered
    assert index.probes < len(index.centroids) / 2
    asking = list(range(0, 3_000, 60))
    queries = spark.createDataFrame([(f"k{i:05d}", [float(x) for x in vectors[i]]) for i in asking], "query_id string, embedding array<float>")
    found = {}
    for r in ann.search_many(index, queries, 10).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    hits = sum(len(found[f"k{i:05d}"] & set(_exact(vectors, vectors[i], 10, lambda j: j != i))) for i in asking)  # noqa: B023
    assert hits >= 0.9 * 10 * len(asking)
    plan = ann.search(index, spark, vectors[0], 10)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_copies_and_nothing(spark, clustered, tmp_path):
    df, vectors, index = clustered
    queries = spark.createDataFrame([("q", [float(x) for x in vectors[-1]])], "query_id string, embedding array<float>")
    got = ann.search_many(index, queries, 3, len(index.centroids)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and all(r["score"] > 0.999999 for r in got)
    empty = ann.build_index(df.limit(0), str(tmp_path / "e"))
    assert ann.search(empty, spark, [1.0], 3).collect() == [] and ann.search_many(empty, queries, 3).collect() == []


def test_recall_on_the_given_table(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = ann.build_index(rows, str(tmp_path / "i"))
    queries = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    truth = {(r["query_id"], r["id"]) for r in ann.search_many(index, queries, 10, len(index.centroids)).collect()}
    got = {(r["query_id"], r["id"]) for r in ann.search_many(index, queries, 10).collect()}
    assert len(truth & got) >= 0.9 * len(truth)
    one = rows.where("id = 40").first()["embedding"]
    exact = [r["id"] for r in memory.vector_topk(rows, one, 10).collect()]
    assert [r["id"] for r in ann.search(index, spark, one, 10, len(index.centroids)).collect()] == exact
