"""Connected components of an edge table: a bounded remainder at once, more by large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, in_worker, written

#: Rounds after which something is wrong: each round at least halves the longest path, roughly.
ROUNDS = 60
#: Edges that one task settles by itself (16 MB); more go through rounds.
TOGETHER = 1 << 20

COMPONENTS = "node long, component long"


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges u-v, sorted, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(further := low[low], low):
            low = further


@in_worker("hashes")
def _at_once(batches):
    u, v = [], []
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
    if u:
        nodes, low = labels(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it is connected with), for each node that has an edge to another.

    Up to TOGETHER distinct edges are settled by one task. More go through
    rounds, in which each node first tells its larger neighbours, then its
    smaller ones, of the smallest node it knows of. Rounds are written tables;
    only a count and a sum of each come to the driver, which stop the rounds once
    they stay as they were. Nodes with many edges are aggregated before the
    shuffle. Null nodes and loops are dropped; repeated edges count once.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    if now.count() <= TOGETHER:
        return now.coalesce(1).mapInArrow(_at_once, COMPONENTS)
    before = None
    for _ in range(ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        last, now = now, written(small.distinct(), "stars")
        discard(last, large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return low_of(now)
        before = tuple(state)
    raise RuntimeError("the components did not settle")


def low_of(stars: DataFrame) -> DataFrame:
    nodes = stars.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
