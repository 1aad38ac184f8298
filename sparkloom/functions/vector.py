"""Vectors as arrays: similarity, parsing, bytes, and an embedder for use without a model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(vector) -> Column:
    """A vector as one constant."""
    return F.from_json(F.lit(str([float(x) for x in vector])), "array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def once(value: Column, use) -> Column:
    """use(value), of which value is computed once a row: an expression that a lambda uses is computed anew for each element, unless an array of one value names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(a: Column) -> Column:
    """A vector over its length, as doubles; null where it has none."""
    return once(norm(a), lambda length: F.when(length > 0, F.transform(a, lambda x: x / length)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null or empty, has no length, or another size than the other."""
    na, nb = norm(a), norm(b)
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.coalesce(F.when(fit, dot(a, b) / (na * nb)), F.lit(0.0))


def parse(text: Column) -> Column:
    """A vector from a JSON array; null for anything else or an empty one."""
    found = F.from_json(text, "array<float>")
    return F.when((F.size(found) > 0) & ~F.exists(found, lambda x: x.isNull()), found)


@F.pandas_udf(T.BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    import numpy as np

    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(blobs: pd.Series) -> pd.Series:
    """Null where bytes aren't whole floats."""
    import numpy as np

    return blobs.map(lambda b: None if b is None or len(b) % 4 or not len(b) else np.frombuffer(b, "<f4"))


def hashed(text: Column, size: int = 64) -> Column:
    """A unit vector of hashed words: a stand-in for a model that needs no network. Null for texts without words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    counted = lambda ps: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(ps, lambda p: p == i)).cast("double"))
    scaled = lambda counts: once(norm(counts), lambda length: F.transform(counts, lambda c: (c / length).cast("float")))
    return once(places, lambda ps: F.when(F.size(ps) > 0, once(counted(ps), scaled)))
