"""An inverted-file index over vectors: cells by a coarse quantiser, residual codes, exact re-rank.

k-means finds at most MOST_CELLS centroids on a bounded sample; every row then
goes to its nearest one. The index is a table partitioned by cell, so that a
search reads the cells it probes and no others. A row has a code of one byte a
dimension, its residual from the centroid, and how far the code is off: what a
search reads first. It gives bounds for the cosine; only rows whose upper bound
reaches the k-th best lower bound are read as whole vectors. So a search is exact
within its cells, and over all cells it is exact.

How many cells a search probes is measured when an index is made: the fewest by
which rows of the sample find TARGET of their nearest neighbours there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import keep_first

#: Rows that the quantiser is fitted on, the most cells (their centroids go with every task), and rounds of k-means.
SAMPLE, MOST_CELLS, ROUNDS = 100_000, 4_096, 10
#: Rows of the sample that are compared, and those that ask, to measure how many cells to probe; neighbours they look for, and the share of them to be found.
COMPARED, ASKING, NEIGHBOURS, TARGET = 4_096, 256, 10, 0.95
#: Rows of a file of the index, and rows of a cell that a task holds in searches by many queries.
FILE_ROWS, BLOCK = 100_000, 8_192


@dataclass
class Index:
    """Where an index lies, its centroids (unit vectors, sorted by cell), and how many cells a search probes."""

    path: str
    centroids: np.ndarray
    probes: int
    key: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")

    def nearest_cells(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The cells to probe for each vector, the nearest first."""
        n = min(probes or self.probes, len(self.centroids))
        return np.argsort(-(vectors @ self.centroids.T), axis=1, kind="stable")[:, :n]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _with_length(df: DataFrame, embedding: str) -> DataFrame:
    squares = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return df.where((F.size(embedding) > 0) & (squares > 0))


def fit_cells(df: DataFrame, cells: int | None = None, embedding: str = "embedding", key: str = "id", sample: int = SAMPLE) -> tuple[np.ndarray, int]:
    """(centroids, cells to probe) of vectors of one size, from about sample rows, those with the smallest hashes of their key.

    Without a number of cells it is the root of the number of rows, MOST_CELLS at most.
    """
    rows = _with_length(df, embedding).select(key, embedding)
    n = rows.count()
    if not n:
        return np.zeros((0, 0)), 1
    share = min(1.0, sample / n)
    some = rows.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    some = some.select(array_to_vector(embedding).alias("features"), F.xxhash64(F.lit(1), F.col(key).cast("string")).alias("h"))
    k = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS, n))
    model = KMeans(k=k, seed=7, maxIter=ROUNDS, distanceMeasure="cosine", initMode="random").fit(some)
    centroids = _unit(np.array(model.clusterCenters()))
    compared = np.array([r["features"].toArray() for r in some.orderBy("h").limit(COMPARED).select("features").collect()])  # COMPARED rows at most
    return centroids, _probes_for(_unit(compared), centroids)


def _probes_for(vectors: np.ndarray, centroids: np.ndarray) -> int:
    """The fewest cells by which the first ASKING vectors find TARGET of their NEIGHBOURS among the vectors."""
    asking = vectors[:ASKING]
    near = asking @ vectors.T
    near[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
    k = min(NEIGHBOURS, len(vectors) - 1)
    if k < 1:
        return len(centroids)
    found = np.argpartition(-near, k - 1, axis=1)[:, :k]
    cell = (vectors @ centroids.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(asking @ centroids.T), axis=1, kind="stable"), axis=1)
    wanted = np.sort(np.take_along_axis(rank, cell[found], axis=1).ravel())
    return int(wanted[math.ceil(TARGET * len(wanted)) - 1]) + 1


CODED = "cell int, code binary, step float, off float"


def coded(df: DataFrame, centroids: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """df with cell, code (residual of the unit vector in steps of a byte), step, and off, the length of what the code leaves out. Vectors without length, or of another size, are left out."""
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(CODED).fields])
    at, size = df.columns.index(embedding), centroids.shape[1]

    def run(batches):
        for batch in batches:
            u = _unit(batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
            cell = (u @ centroids.T).argmax(axis=1)
            residual = u - centroids[cell]
            step = (np.abs(residual).max(axis=1) / 127 + 1e-12).astype(np.float32)
            code = np.rint(residual / step[:, None]).astype(np.int8)
            # rounded up, and a little more for sums of floating numbers
            off = (np.linalg.norm(residual - code * step[:, None].astype(np.float64), axis=1) * (1 + 1e-6) + 1e-9).astype(np.float32)
            made = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(np.nextafter(off, np.float32(np.inf)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return _with_length(df.where(F.size(embedding) == size), embedding).mapInArrow(run, schema)


def build_index(df: DataFrame, path: str, cells: int | None = None, embedding: str = "embedding", key: str = "id") -> Index:
    """Writes the index of df's vectors below path, other columns with them, and returns it.

    Rows of a cell are dealt over as many tasks and files as it needs, however
    many there are. Null and empty vectors, those without length, and those of
    another size than most are not in it.
    """
    spark = df.sparkSession
    rows = df.where(F.col(embedding).isNotNull())
    sizes = rows.groupBy(F.size(embedding).alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size(embedding) == (sizes["size"] if sizes else 0))
    centroids, probes = fit_cells(rows, cells, embedding, key)
    if len(centroids):
        n = rows.count()
        salt = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(max(1, -(-n // FILE_ROWS))))
        made = coded(rows.withColumn("_vector", F.col(embedding)).drop(embedding).withColumnRenamed("_vector", "embedding"), centroids)
        made.repartition("cell", salt).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").mode("overwrite").parquet(f"{path}/cells")
    about = spark.createDataFrame([(json.dumps({"probes": probes, "key": key, "centroids": centroids.tolist()}),)], "value string")
    about.coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return Index(path, centroids, probes, key)


def open_index(spark: SparkSession, path: str) -> Index:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return Index(path, np.array(about["centroids"]).reshape(len(about["centroids"]), -1), about["probes"], about["key"])


def _bounds(batch: pa.RecordBatch, centroids: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the cosine of each row of (cell, code, step, off) with a unit vector is at least and at most."""
    cell = batch.column("cell").to_numpy()
    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(len(batch), -1)
    about = centroids[cell] @ query + batch.column("step").to_numpy().astype(np.float64) * (code @ query)
    off = batch.column("off").to_numpy().astype(np.float64)
    return about - off, about + off


def search(index: Index, spark: SparkSession, query: Sequence[float], k: int, probes: int | None = None, where=None) -> DataFrame:
    """(key, score) of the k rows of the probed cells most similar to query; ties by key. where: a condition on the index's other columns.

    With as many probes as cells the result is exact.
    """
    key, vector = index.key, np.asarray(query, np.float64)
    unit = vector / max(float(np.linalg.norm(vector)), 1e-300)
    names = [int(c) for c in index.nearest_cells(unit[None, :], probes)[0]] if len(index.centroids) and len(unit) == index.centroids.shape[1] else []
    if not names:
        return spark.createDataFrame([], f"{key} string, score double")
    rows = index.rows(spark).where(F.col("cell").isin(names))
    rows = rows.where(where) if where is not None else rows
    centroids, fields = index.centroids, rows.schema

    def run(batches):
        for batch in batches:
            lower, upper = _bounds(batch, centroids, unit)
            reached = np.partition(lower, -k)[-k] if len(lower) > k else -np.inf
            keep = np.flatnonzero(upper >= reached)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(lower[keep]), pa.array(upper[keep])], names=[key, "cell", "lower", "upper"])

    bounds = rows.select(key, "cell", "code", "step", "off").mapInArrow(run, T.StructType([fields[key], fields["cell"], *T.StructType.fromDDL("lower double, upper double").fields]))
    best = bounds.orderBy(F.desc("lower")).limit(k).agg(F.min("lower")).first()[0]
    near = bounds.where(F.col("upper") >= (best if best is not None else 0.0)).select(key, "cell")
    whole = rows.select(key, "cell", "embedding").join(near, [key, "cell"], "left_semi")

    def exact(batches):
        for batch in batches:
            u = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_unit(u) @ unit)], names=[key, "score"])

    scored = whole.select(key, "embedding").mapInArrow(exact, T.StructType([fields[key], T.StructField("score", T.DoubleType())]))
    return scored.orderBy(F.desc("score"), key).limit(k)


def search_many(index: Index, queries: DataFrame, k: int, probes: int | None = None, embedding: str = "embedding", query_key: str = "query_id", with_self: bool = False) -> DataFrame:
    """(query_key, key, score, rank) for each row of queries: its k most similar rows of the cells it probes; ties by key.

    Cells are cut into blocks of bounded size. A task holds one block and streams
    the queries that probe it, each of which leaves k rows there; these are what
    moves on. Rows whose key is the query's own are left out.
    """
    spark, key, centroids = queries.sparkSession, index.key, index.centroids
    kinds = dict(queries.dtypes)
    result = f"{query_key} {kinds[query_key]}, {key} {dict(index.rows(spark).dtypes)[key] if len(centroids) else kinds[query_key]}, score double"
    if not len(centroids):
        return spark.createDataFrame([], result + ", rank int")
    rows = index.rows(spark).select("cell", F.col(key).alias("_key"), F.col("embedding").cast("array<float>").alias("_vector"))
    blocks = rows.groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))  # a row a cell, MOST_CELLS at most
    members = rows.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), F.lit(None).cast(kinds[query_key]).alias("_query"), "_key", "_vector")
    asked = _with_length(queries.where(F.size(embedding) == centroids.shape[1]), embedding).select(F.col(query_key).alias("_query"), F.col(embedding).cast("array<float>").alias("_vector"))
    reach = T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def place(batches):
        for batch in batches:
            u = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(index.nearest_cells(u, probes).astype(np.int32)), pa.list_(pa.int32()))], names=reach.names)

    visits = asked.mapInArrow(place, reach).select("_query", "_vector", F.explode("cells").alias("cell")).join(F.broadcast(blocks), "cell")
    visits = visits.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "_query", F.lit(None).cast(dict(rows.dtypes)["_key"]).alias("_key"), "_vector")
    both = members.unionByName(visits)

    def compare(batches):
        at, held, matrix, keys = None, [], None, None
        for batch in batches:
            cell, block, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])]))
            for a, b in zip(edges, [*edges[1:], len(batch)]):
                part = batch.slice(a, b - a)
                if (cell[a], block[a]) != at:
                    at, held, matrix = (cell[a], block[a]), [], None
                if not asks[a]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if matrix is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    keys, matrix = table.column("_key").chunk(0), _unit(table.column("_vector").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1))
                for low in range(0, b - a, 512):
                    some = part.slice(low, 512)
                    scores = _unit(some.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1)) @ matrix.T
                    n = min(k + 1, scores.shape[1])
                    reached = np.partition(scores, -n, axis=1)[:, [-n]]  # a row more, as a query may meet itself
                    more, tied = scores > reached, scores == reached
                    i, j = np.nonzero(more | (tied & (np.cumsum(tied, axis=1) <= n - more.sum(axis=1, keepdims=True))))  # rows come by key
                    yield pa.RecordBatch.from_arrays([some.column(3).take(pa.array(i)), keys.take(pa.array(j)), pa.array(scores[i, j])], names=[query_key, key, "score"])

    found = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "asks", "_key").mapInArrow(compare, result)
    if not with_self:
        found = found.where(F.col(query_key) != F.col(key))
    first = keep_first(found, [query_key], F.desc("score"), key, most=k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key)))
