"""An index for searches by parts of texts: lists of keys by three characters.

Texts are lower-cased. Every three characters that a text has are a gram; lists
of (gram, keys) are a table partitioned by the gram's bucket and sorted by gram,
and the texts themselves are one partitioned by the key's bucket. A search reads
the buckets of its term's rarest grams, keeps the keys that have all of these, and
verifies the term on those texts, whose buckets are known by then. A term of fewer
than three characters is looked for in all texts. A row lists the keys of one
stretch of texts, so that a gram that every text has is as many rows in as many
files as it takes, never one value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, written

#: Characters of a gram, buckets of each table, and rows of a file.
SIZE, BUCKETS, FILE_ROWS = 3, 64, 2_000_000
#: Characters of texts whose grams are listed at a time (a task takes 100 MB for them), and texts and rows of lists that a task writes.
STRETCH, TASK_TEXTS, TASK_ROWS = 1 << 20, 250_000, 1_000_000
#: Grams of a term that lists are read for: the rarest ones.
READ = 4


@dataclass
class TextIndex:
    path: str
    buckets: int
    key_type: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """texts (key, text, part), lists (gram, keys, bucket) or counts (gram, n, bucket), the last column being the folder's."""
        columns = {"texts": f"key {self.key_type}, text string, part int", "lists": f"gram string, keys array<{self.key_type}>, bucket int", "counts": "gram string, n long, bucket int"}
        return spark.read.schema(columns[name]).parquet(f"{self.path}/{name}")


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _listed(batches):
    """gram and keys, over rows of key and text: a row for each gram of a stretch of texts, with the keys of those that have it.

    A character is 21 bits, so that a gram is a number, found in time that grows
    with the text.
    """
    for batch in batches:
        texts, at = batch.column(1).to_pylist(), 0
        while at < len(texts):
            low, size, found, owners = at, 0, [], []
            while at < len(texts) and (at == low or size + len(texts[at]) <= STRETCH):
                points = np.frombuffer(texts[at].encode("utf-32-le"), "<u4").astype(np.int64)
                grams = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])
                found.append(grams)
                owners.append(np.full(len(grams), at))
                size += len(texts[at])
                at += 1
            grams, owners = np.concatenate(found), np.concatenate(owners)
            order = np.argsort(grams, kind="stable")
            grams, owners = grams[order], owners[order]
            first = np.flatnonzero(np.diff(grams, prepend=-1))
            names = ["".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in grams[first].tolist()]
            keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(grams)).astype(np.int32)), batch.column(0).take(pa.array(owners)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), keys], names=["gram", "keys"])


def _tasks(rows: DataFrame, buckets: int, most: int) -> int:
    """Tasks for each bucket, so that one has about so many rows at most."""
    return max(1, -(-rows.count() // (buckets * most)))


def build_text_index(rows: DataFrame, path: str, key: str, text: Column, buckets: int = BUCKETS) -> TextIndex:
    """Writes an index of text (null: not found by any term) by key, whose values are distinct, below path."""
    spark, made = rows.sparkSession, TextIndex(path, buckets, dict(rows.dtypes)[key])
    low = rows.select(F.col(key).alias("key"), F.lower(text).alias("text")).where("text is not null")
    store = lambda df, name, by: df.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(by).mode("overwrite").parquet(f"{path}/{name}")
    low = low.withColumn("part", bucket_of(F.col("key"), buckets))
    dealt = lambda n: F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n))
    n = _tasks(low, buckets, TASK_TEXTS)
    store(low.repartition(buckets * n, "part", dealt(n)), "texts", "part")
    texts = made.table(spark, "texts").select("key", "text")
    lists = written(texts.mapInArrow(_listed, f"gram string, keys array<{made.key_type}>"), "lists").withColumn("bucket", bucket_of(F.col("gram"), buckets))
    # a gram may be in every stretch: its rows are dealt by their keys as well
    n = _tasks(lists, buckets, TASK_ROWS)
    store(lists.repartition(buckets * n, "bucket", F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(n))).sortWithinPartitions("bucket", "gram"), "lists", "bucket")
    counts = made.table(spark, "lists").groupBy("bucket", "gram").agg(F.sum(F.size("keys").cast("long")).alias("n"))
    store(counts.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram"), "counts", "bucket")
    return made


def term_grams(term: str) -> list[str]:
    low = term.lower()
    return sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})


def candidates(index: TextIndex, spark: SparkSession, term: str) -> DataFrame:
    """The keys of texts that have the rarest grams of a term of three characters or more; none where a gram is in no text."""
    grams = spark.createDataFrame([(g,) for g in term_grams(term)], "gram string").withColumn("bucket", bucket_of(F.col("gram"), index.buckets)).collect()
    buckets = sorted({r["bucket"] for r in grams})
    wanted = [r["gram"] for r in grams]
    there = index.table(spark, "counts").where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted)).orderBy("n", "gram").collect()  # a row a gram of the term
    lists = index.table(spark, "lists")
    if len(there) < len(wanted):
        return lists.select(F.explode("keys").alias("key")).limit(0)
    rare = there[:READ]
    read = lists.where(F.col("bucket").isin(sorted({r["bucket"] for r in rare})) & F.col("gram").isin([r["gram"] for r in rare]))
    return read.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("key")


def search_text(index: TextIndex, spark: SparkSession, term: str) -> DataFrame:
    """The keys of texts that contain term in any case; all keys for an empty one. Jobs run while this is called."""
    texts, wanted = index.table(spark, "texts"), term.lower()
    if len(wanted) < SIZE:
        return texts.where(F.contains("text", F.lit(wanted))).select("key")
    found = cut(candidates(index, spark, term).withColumn("part", bucket_of(F.col("key"), index.buckets)))
    parts = sorted(r["part"] for r in found.select("part").distinct().collect())  # as many as buckets at most
    return texts.where(F.col("part").isin(parts) & F.contains("text", F.lit(wanted))).join(found, ["part", "key"], "left_semi").select("key")
