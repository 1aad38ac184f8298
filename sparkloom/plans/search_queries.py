"""Queries that go through an index, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, filters, lsh, trigrams
from ..storage import shared_folder
from .frames import ENTITIES, entities, first_vector, memories, read
from .memory_queries import COS, MEM, Q


def _index(spark, sf_dir) -> ann.Index:
    rows = memories(spark, sf_dir).select("id", "tenant_id", "project", "embedding")
    return ann.build_index(rows, shared_folder(spark, "vectors"))


def _asking(spark, sf_dir):
    return memories(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


def ann_topk(spark, sf_dir):
    """All cells are probed: the exact result."""
    index = _index(spark, sf_dir)
    return ann.search(index, spark, first_vector(spark, sf_dir), 10, probes=len(index.centroids)).withColumn("score", F.round("score", 6))


def ann_topk_filtered(spark, sf_dir):
    index = _index(spark, sf_dir)
    return ann.search(index, spark, first_vector(spark, sf_dir), 10, len(index.centroids), F.expr("tenant_id = 't0' and project = 'p1'")).withColumn("score", F.round("score", 6))


def ann_neighbours(spark, sf_dir):
    """All cells are probed by many queries: the exact neighbours."""
    index = _index(spark, sf_dir)
    return ann.search_many(index, _asking(spark, sf_dir), 10, len(index.centroids)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def ann_search(spark, sf_dir):
    """As many cells as were measured: tests hold its recall against ann_neighbours."""
    return ann.search_many(_index(spark, sf_dir), _asking(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def hashed_pairs(spark, sf_dir):
    """At least nine in ten of near_dup_pairs' rows: tests hold it against them."""
    return lsh.similar_pairs_hashed(memories(spark, sf_dir), [], ["created_at"], 0.35).select("earlier", "later", F.round("similarity", 6).alias("similarity"))


def name_contains_indexed(spark, sf_dir):
    index = trigrams.build_text_index(read(spark, sf_dir, "part"), shared_folder(spark, "names"), "p_partkey", F.col("p_name"), buckets=8)
    return trigrams.search_text(index, spark, "Red").select(F.col("key").alias("p_partkey"))


def path_search_indexed(spark, sf_dir):
    paths = entities(spark, sf_dir).withColumn("file_path", F.regexp_replace("file_path", "/", "\\\\"))
    index = trigrams.build_text_index(paths, shared_folder(spark, "paths"), "id", filters.path_text(F.col("file_path"), F.col("id")), buckets=8)
    return trigrams.search_text(index, spark, "BRAND#12/").select(F.col("key").alias("id"))


def text_search(spark, sf_dir):
    """Whole documents that hold a word and what follows it in the first document."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = rows.where("length(text) > 60").orderBy("doc_id").select(F.substring("text", 21, 6)).first()[0]
    index = trigrams.build_text_index(rows, shared_folder(spark, "texts"), "doc_id", F.col("text"), buckets=16)
    return trigrams.search_text(index, spark, wanted).select(F.col("key").alias("doc_id"))


QUERIES = {f.__name__: f for f in (ann_topk, ann_topk_filtered, ann_neighbours, ann_search, hashed_pairs, name_contains_indexed, path_search_indexed, text_search)}

SQL = {
    "name_contains_indexed": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red')",
    "path_search_indexed": f"WITH n AS ({ENTITIES}) SELECT id FROM n WHERE contains(lower(file_path), 'brand#12/')",
    "text_search": "SELECT doc_id FROM documents, (SELECT lower(substr(text, 21, 6)) AS w FROM documents WHERE length(text) > 60 ORDER BY doc_id LIMIT 1) WHERE contains(lower(text), w)",
    "ann_topk": f"WITH {MEM}, {Q} SELECT id, round({COS}, 6) AS score FROM m, q ORDER BY {COS} DESC, id LIMIT 10",
    "ann_topk_filtered": f"WITH {MEM}, {Q} SELECT id, round({COS}, 6) AS score FROM m, q WHERE tenant_id = 't0' AND project = 'p1' ORDER BY {COS} DESC, id LIMIT 10",
    "ann_neighbours": f"""WITH {MEM}, s AS (SELECT a.id AS query_id, b.id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM m a JOIN m b ON a.id % 20 = 0 AND a.id <> b.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
}
