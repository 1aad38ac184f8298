"""Similar pairs by signs of random hyperplanes: work below all pairs where vectors are spread.

A vector's signs on bands of hyperplanes are its keys; vectors at an angle agree
on a sign with a probability that the angle gives, so that the number of bands
follows from the threshold and the recall wanted. Vectors that share a key meet
in a task, which compares them exactly and gives a pair only in the first band
that both share, so that none comes twice. memory.similar_pairs is the exact way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import unit
from ..storage import cut

#: Vectors that a key should have on average, the most bands, and vectors of a key that a task holds at a time.
BUCKET, MOST_BANDS, BLOCK = 64, 128, 4_096
SEED = 11


def bands_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(signs of a band, bands): as many signs as n vectors need, fewer if the recall would take more than MOST_BANDS."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    signs = max(1, min(30, round(math.log2(max(2, n) / BUCKET))))
    while True:
        met = same**signs
        bands = 1 if met >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - met))
        if bands <= MOST_BANDS or signs == 1:
            return signs, max(1, bands)
        signs -= 1


def _signed(signs: int, bands: int, schema: T.StructType, vector: str):
    """Adds codes, a number for each band, to rows with unit vectors."""
    at, planes = schema.names.index(vector), {}

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            sizes = pc.list_value_length(column).to_numpy()
            codes = np.zeros((len(batch), bands), np.int32)
            for size in np.unique(sizes):
                if size not in planes:
                    planes[size] = np.random.default_rng(SEED).normal(size=(int(size), signs * bands)).astype(np.float32)
                own = np.flatnonzero(sizes == size)
                u = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                bits = (u @ planes[size] > 0).reshape(len(own), bands, signs)
                codes[own] = bits @ (1 << np.arange(signs, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.list_(pa.int32()))], names=[*schema.names, "codes"])

    return run


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _compare(threshold: float, names: Sequence[str], group: Sequence[str]):
    """Over rows sorted by bucket, block and visits: the rows of a block are compared with each other, then with those that visit it."""

    def pairs(x: pa.RecordBatch, y: pa.RecordBatch, within: bool):
        ux, uy, band = _matrix(x.column("_u")), _matrix(y.column("_u")), x.column("band")[0].as_py()
        cx, cy = _matrix(x.column("codes"), np.int32)[:, :band], _matrix(y.column("codes"), np.int32)[:, :band]
        rx, ry = x.column("_r").to_numpy(), y.column("_r").to_numpy()
        for low in range(0, len(x), 512):
            product = ux[low : low + 512] @ uy.T
            i, j = np.nonzero(product > threshold)
            value = product[i, j]
            i += low
            keep = (rx[i] < ry[j]) if within else np.ones(len(i), bool)
            keep &= ~(cx[i] == cy[j]).any(axis=1)
            i, j, value = i[keep], j[keep], value[keep]
            first = pa.array(rx[i] < ry[j])
            kx, ky = x.column("_k").take(pa.array(i)), y.column("_k").take(pa.array(j))
            yield pa.RecordBatch.from_arrays([*(x.column(g).take(pa.array(i)) for g in group), pc.if_else(first, kx, ky), pc.if_else(first, ky, kx), pa.array(value)], names=[*group, "earlier", "later", "similarity"])

    def run(batches):
        at, held, members = None, [], None
        for batch in batches:
            bucket, block, visits = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            code = bucket.indices.to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1]) | (visits[1:] != visits[:-1])]))
            for a, b in zip(edges, [*edges[1:], len(batch)]):
                here = bucket.dictionary[int(code[a])].as_py(), int(block[a])
                if here != at:
                    if held and members is None and sum(map(len, held)) > 1:
                        own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        yield from pairs(own, own, True)
                    at, held, members = here, [], None
                part = batch.slice(a, b - a)
                if not visits[a]:
                    held.append(part)
                elif held:
                    if members is None:
                        members = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        yield from pairs(members, members, True)
                    yield from pairs(part, members, False)
        if held and members is None and sum(map(len, held)) > 1:
            own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield from pairs(own, own, True)

    return run


def similar_pairs_hashed(df: DataFrame, group: Sequence[str], order: Sequence[str], threshold: float, embedding: str = "embedding", key: str = "id", recall: float = 0.95) -> DataFrame:
    """As memory.similar_pairs, but only pairs that share a key: at least recall of those at the threshold, more of the nearer ones.

    A key that many vectors have is cut into blocks, each of which visits half of
    the others, so that no task holds more than a block. Jobs run while this is
    called.
    """
    group = list(group)
    rows = df.where(F.size(embedding) > 0).select(*group, *order, F.col(key).alias("_k"), F.col(embedding).alias("_v"))
    placed = rows.orderBy(*order, "_k").select(*group, "_k", unit(F.col("_v")).cast("array<float>").alias("_u"), F.monotonically_increasing_id().alias("_r"))
    units = cut(placed.where("_u is not null"))
    signs, bands = bands_for(units.count(), threshold, recall)
    schema = T.StructType([*units.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])
    signed = cut(units.mapInArrow(_signed(signs, bands, units.schema, "_u"), schema))
    keyed = signed.select("_r", F.to_json(F.struct(*group, F.size("_u"))).alias("_g"), F.posexplode("codes").alias("band", "code")).select("_r", F.concat_ws(":", "_g", "band", "code").alias("_bucket"), "band")
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("n")).where("n > 1").select("_bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = keyed.join(counts, "_bucket").groupBy("_r").agg(F.collect_list(F.struct("_bucket", "band", "blocks")).alias("_m"))  # a row's bands at most
    each = signed.join(met, "_r").select(*group, "_k", "_u", "_r", "codes", F.explode("_m").alias("_m")).select(*group, "_k", "_u", "_r", "codes", "_m.*")
    own = F.pmod(F.xxhash64("_r"), F.col("blocks")).cast("int")
    # a block visits those behind it, half way round; where two face each other, the lower one visits
    half = F.floor(F.col("blocks") / 2).cast("int")
    others = F.filter(F.sequence(F.lit(1), F.greatest(half, F.lit(1))), lambda d: (d <= half) & ((d * 2 < F.col("blocks")) | (F.col("_own") < half)))
    places = F.concat(F.array(F.struct(F.col("_own").alias("block"), F.lit(False).alias("visits"))), F.transform(others, lambda d: F.struct(F.pmod(F.col("_own") + d, F.col("blocks")).alias("block"), F.lit(True).alias("visits"))))
    dealt = each.withColumn("_own", own).select("*", F.explode(places).alias("_p")).select("_bucket", "_p.block", "_p.visits", *group, "_k", "_u", "_r", "codes", "band")
    kinds = dict(df.dtypes)
    made = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), f"earlier {kinds[key]}, later {kinds[key]}, similarity double"])
    return dealt.repartition("_bucket", "block").sortWithinPartitions("_bucket", "block", "visits").mapInArrow(_compare(threshold, dealt.columns, group), made)
