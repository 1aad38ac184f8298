"""Line dedup: documents probe sharded arrays behind minimal perfect hashes.

1. A line's key (stripped, A-Z lower-cased) is hashed to 128 bits. Keys are
   counted by document, with the largest doc_id that holds them; those that
   enough documents have are written, 28 bytes a line.
2. They are dealt into shards of about SHARD lines by their hash. A shard is a
   minimal perfect hash over its lines (bits a level: a hash that is alone at its
   place settles there, the others go on to the next level; the rank of a bit is
   the line's place) and, by place, compact arrays of 64-bit fingerprints, counts
   and owners. A line that isn't there meets an empty bit or another fingerprint,
   except one in 2^64.
3. A batch of documents sends each shard one packed row of probes; a task holds
   one shard's arrays and streams the probes by them. Lines that a larger share
   of documents have than any shard should answer for are a bounded number, whose
   arrays go with every task.
4. Only lines that have to go are answered, by document, and taken out of its text.

No line is joined with lines, and no arrays are held but those of one shard.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import HEAVY, LIGHT, discard, in_worker, written

#: Characters of a key, and documents that have it, from which on its lines go.
LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3
#: Lines of a shard: some 3 MB of arrays.
SHARD = 1 << 17
#: Places of a level for each line that isn't settled.
ROOM = 2
#: Bytes of texts that are cut into lines at a time.
SLICE = 1 << 24

SPACE = b" \t\n\v\f\r"
K = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class PerfectHash:
    """sizes: places of each level; words: all levels' bits; ranks: bits set before each word."""

    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(low ^ _mix(high + np.uint64((level + 1) * K & (2**64 - 1)))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """Over distinct pairs of hashes."""
        sizes, levels = [], []
        while len(high):
            size = max(64, -(-ROOM * len(high) // 64) * 64)
            at = cls.places(high, low, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at]
            high, low = high[left], low[left]
        return cls.read(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    @classmethod
    def read(cls, sizes: np.ndarray, words: np.ndarray) -> PerfectHash:
        set_bits = np.bitwise_count(words).astype(np.int64)
        return cls(sizes, words, np.cumsum(set_bits) - set_bits)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Places from 0 on without gaps; for others than the hashed ones any place, or -1."""
        out = np.full(len(high), -1, np.int64)
        left, base = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.places(high[left], low[left], level, int(size)) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            left, base = left[~hit], base + int(size)
        return out


@dataclass
class Arrays:
    """What is known of a shard's lines, by the place that the perfect hash gives them."""

    hashed: PerfectHash
    prints: np.ndarray
    counts: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, high, low, counts, owners) -> Arrays:
        hashed = PerfectHash.of(high, low)
        order = np.empty(len(high), np.int64)
        order[hashed.find(high, low)] = np.arange(len(high))
        return cls(hashed, high[order], counts[order].astype(np.uint32), owners[order])

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.hashed.sizes, self.hashed.words, self.prints, self.counts, self.owners)]

    @classmethod
    def read(cls, sizes: bytes, words: bytes, prints: bytes, counts: bytes, owners: bytes) -> Arrays:
        hashed = PerfectHash.read(np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64))
        return cls(hashed, np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32), np.frombuffer(owners, np.int64))

    def look_up(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are there, and their places (of no use for the others)."""
        at = self.hashed.find(high, low)
        there = at >= 0
        there[there] = self.prints[at[there]] == high[there]
        return there, at


def keyed_lines(text: str, least: int) -> tuple[list[bytes], list[int | None]]:
    """The lines of a text and the 128-bit hash of each one's key, None for keys that are too short."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    hashes: list[int | None] = []
    for line in lines:
        key = line.strip(SPACE)
        if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least):
            hashes.append(None)
        else:
            hashes.append(xxhash.xxh3_128_intdigest(key.lower()))
    return lines, hashes


def _halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(h.to_bytes(16, "little") for h in hashes), np.uint64).reshape(-1, 2)
    return data[:, 1].copy(), data[:, 0].copy()


def _hashed(least: int):
    """Over batches whose second column is text: yields (place of the row, high, low) of the distinct keys of some rows."""

    def run(batch):
        place, hashes, size = [], [], 0
        for i, text in enumerate(batch.column(1)):
            text = text.as_py()
            if text is not None and len(text) >= least:
                own = set(keyed_lines(text, least)[1]) - {None}
                place += [i] * len(own)
                hashes += own
                size += len(text)
            if size > SLICE:
                yield np.array(place, np.int64), *_halves(hashes)
                place, hashes, size = [], [], 0
        if hashes:
            yield np.array(place, np.int64), *_halves(hashes)

    return run


COUNTED = "high long, low long, doc_id long"


def frequent_lines(documents: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """high, low (the halves of a key's hash), n (distinct ids of documents with it), owner (the largest) of keys in enough documents.

    Rows without an id count for nothing, rows that share one count once.
    """
    hashed = _hashed(least_length)

    def run(batches):
        for batch in batches:
            for place, high, low in hashed(batch):
                yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), batch.column(0).take(pa.array(place))], names=["high", "low", "doc_id"])

    ids = documents.select("doc_id").where("doc_id is not null")
    rows = documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(in_worker("lines")(run), COUNTED)
    if not ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.distinct()
    return rows.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner")).where(F.col("n") >= least_documents)


def _arrays_of(rows: list[pa.RecordBatch]) -> Arrays:
    table = pa.Table.from_batches(rows)
    column = lambda name: table.column(name).to_numpy()
    return Arrays.of(column("high").view(np.uint64), column("low").view(np.uint64), column("n"), column("owner"))


INDEX = "shard int, kind int, sizes binary, words binary, prints binary, counts binary, owners binary, probes binary"
NAMES = [x.split()[0] for x in INDEX.split(", ")]
ARRAYS, PROBES, PROBES_WITHOUT_ID = 0, 1, 2


def sharded_index(lines: DataFrame, shards: int) -> DataFrame:
    """A row a shard (INDEX without probes) over rows of frequent_lines()."""

    def run(batches):
        shard, held = None, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([ARRAYS], pa.int32()), *(pa.array([x], pa.binary()) for x in _arrays_of(held).packed()), pa.array([None], pa.binary())], names=NAMES)

        for batch in batches:
            own = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for a, b in zip(edges, [*edges[1:], len(own)]):
                if held and own[a] != shard:
                    yield made()
                    held = []
                shard = int(own[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield made()

    dealt = lines.select(F.pmod("high", F.lit(shards)).cast("int").alias("shard"), "high", "low", "n", "owner")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(in_worker("lines")(run), INDEX)


def _probes(shards: int, least: int, common):
    """Packs the keys of a batch's documents by shard, those of common lines left out: rows of INDEX with probes."""
    hashed = _hashed(least)

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2).to_numpy()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc_ids = ids.fill_null(0).to_numpy()
            for place, high, low in hashed(batch):
                left = ~common.value.look_up(high, low)[0]
                place, high, low = place[left], high[left], low[left]
                shard = np.mod(high.view(np.int64), shards).astype(np.int32)
                kind = np.where(known[place], PROBES, PROBES_WITHOUT_ID).astype(np.int32)
                order = np.lexsort((kind, shard))
                place, high, low, shard, kind = (x[order] for x in (place, high, low, shard, kind))
                edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])) if len(shard) else []
                packed = [np.stack([keys[place[a:b]], doc_ids[place[a:b]], high[a:b].view(np.int64), low[a:b].view(np.int64)]).tobytes() for a, b in zip(edges, [*edges[1:], len(shard)])]
                none = pa.nulls(len(packed), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(shard[edges] if len(shard) else [], pa.int32()), pa.array(kind[edges] if len(shard) else [], pa.int32()), none, none, none, none, none, pa.array(packed, pa.binary())], names=NAMES)

    return run


ANSWERS = "row_key long, line long"


def _answer(batches):
    """Over rows of INDEX by shard, arrays first: the lines that documents lose."""
    shard, arrays = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == ARRAYS:
                shard, arrays = r["shard"], Arrays.read(*(r[x] for x in NAMES[2:7]))
            elif r["shard"] == shard:
                keys, doc_ids, high, low = np.frombuffer(r["probes"], np.int64).reshape(4, -1)
                there, at = arrays.look_up(high.view(np.uint64), low.view(np.uint64))
                if r["kind"] == PROBES:
                    there[there] = arrays.owners[at[there]] != doc_ids[there]
                yield pa.RecordBatch.from_arrays([pa.array(keys[there]), pa.array(low[there])], names=["row_key", "line"])


DEDUPED = {"n_lines": "long", "n_dropped": "long", "kept_sha256": "string", "kept_text": "string"}


def dedup_lines(documents: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, shard: int = SHARD, fields: tuple[str, ...] = ("n_lines", "n_dropped", "kept_sha256")) -> DataFrame:
    """doc_id and fields of DEDUPED, a row for each row: texts without the lines that enough documents have, but in the largest doc_id.

    A null or empty text is one empty line. Rows without an id count for nothing
    and lose all such lines; rows that share an id are one document, so that all
    of those with the largest id keep them. Lines repeated in one document stay or
    go together. A table without rows gives none. Other columns are ignored.
    """
    spark = documents.sparkSession
    keyed = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    lines = written(frequent_lines(documents, least_length, least_documents), "lines")
    total, n, most = lines.agg(F.sum("n"), F.count("*"), F.max("n")).first()
    limit = max((total or 0) // HEAVY, LIGHT)
    hot = [tuple(r) for r in lines.where(F.col("n") > limit).select("high", "low", "n", "owner").collect()] if (most or 0) > limit else []  # HEAVY at most
    column = lambda i, kind=np.int64: np.array([r[i] for r in hot], np.int64).view(kind)
    common = spark.sparkContext.broadcast(Arrays.of(column(0, np.uint64), column(1, np.uint64), column(2), column(3)))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // shard))
    index = sharded_index(lines.where(F.col("n") <= limit), shards)
    probes = keyed.mapInArrow(in_worker("lines")(_probes(shards, least_length, common)), INDEX)
    asked = index.unionByName(probes).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    answers = written(asked.mapInArrow(in_worker("lines")(_answer), ANSWERS).groupBy("row_key").agg(F.collect_set("line").alias("lines")), "answers")
    discard(lines)
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, " + ", ".join(f"{c} {DEDUPED[c]}" for c in fields)

    def take_out(batches):
        for batch in batches:
            made: dict[str, list] = {c: [] for c in DEDUPED}
            for doc_id, text, gone in zip(batch.column(0), batch.column(1), batch.column(2)):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                kept, hashes = keyed_lines(text, least_length)
                n_lines = len(kept)
                some = [i for i, h in enumerate(hashes) if h is not None]
                if some:
                    high, low = _halves([hashes[i] for i in some])
                    there, at = common.value.look_up(high, low)
                    if doc_id is not None:
                        there[there] = common.value.owners[at[there]] != doc_id
                    if gone.is_valid:
                        there |= np.isin(low.view(np.int64), gone.values.to_numpy())
                    out = {some[i] for i in np.flatnonzero(there)}
                    kept = [x for i, x in enumerate(kept) if i not in out] if out else kept
                data = b"\n".join(kept)
                made["n_lines"].append(n_lines)
                made["n_dropped"].append(n_lines - len(kept))
                made["kept_sha256"].append(hashlib.sha256(data).hexdigest())
                made["kept_text"].append(data.decode("utf-8", "surrogatepass") if "kept_text" in fields else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[c], pa.string() if DEDUPED[c] == "string" else pa.int64()) for c in fields)], names=["doc_id", *fields])

    return keyed.join(answers.hint("shuffle_hash"), "row_key", "left").select("doc_id", "text", "lines").mapInArrow(in_worker("lines")(take_out), schema)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import table

    return dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
k AS (SELECT r, doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.r, k.doc_id, k.line, k.i, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.owner AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
