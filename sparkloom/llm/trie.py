"""Prefix trie of conversations: blocks of turns are grouped first, turns only where blocks part.

1. A turn is a digest of its role and text. A task streams the turns of a
   conversation and chains their digests, so that a prefix is 16 bytes; a row is
   written for each BLOCK turns, with the digest at its end as the block's.
2. Conversations are grouped by successive block digests. Where all members of a
   group go on with the same block, its turns' nodes have the same members, and
   the smallest conversation alone gives them.
3. Only the blocks in which siblings part, or some end, are cut into turns, which
   are grouped by their own prefix digests.
4. A node belongs to its smallest member, which owns everything below it on its
   own way as well. So a conversation's nodes are a part of its way that goes to
   its end: sums over it, plus what every other owner tells the nodes above its
   own part, are the sums over subtrees; no more rows than there are turns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import discard, in_worker, join_counted, written

#: Turns of a block.
BLOCK = 4
#: Conversations of the query's contract share the first turns of the first one of so many ids, at most so many of them.
FAMILY, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"

ROOT = b"\0" * 16


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, idx (from 0, by turn, null first, then role and digest), digest and words of each turn; null roles and texts are empty, rows without conv_id dropped."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("idx"), F.unhex("digest").alias("digest"), "words")


def with_shared_heads(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """turns in which each conversation's first h are those of the first of its family, h being its id's hash modulo heads."""
    own = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    rest = turns.where(F.col("idx") >= own)
    members = turns.where("idx = 0").select(F.col("conv_id").alias("member"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"), own.alias("h"))
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("idx") < heads))
    given = first.join(members, (first.conv_id == members.base) & (first.idx < members.h)).select(F.col("member").alias("conv_id"), "idx", "digest", "words")
    return given.unionByName(rest)


CHAINS = "conv_id long, block int, full boolean, last boolean, parent binary, key binary, digests binary, words array<long>"
CHAIN_NAMES = [x.split()[0] for x in CHAINS.split(", ")]


def chained(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row of CHAINS for each block turns of a conversation: the digests of all prefixes that end in it; parent is that of the prefix before it."""

    def run(batches):
        conv, at, parent, digests, words = None, 0, ROOT, [], []
        rows: list[tuple] = []

        def close(last: bool):
            rows.append((conv, at, len(digests) == block, last, parent, digests[-1], b"".join(digests), words))

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=CHAIN_NAMES)
            rows.clear()
            return made

        for batch in batches:
            for c, d, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if c != conv:
                    if digests:
                        close(True)
                    conv, at, parent, digests, words = c, 0, ROOT, [], []
                elif len(digests) == block:
                    close(False)
                    at, parent, digests, words = at + 1, digests[-1], [], []
                digests.append(xxhash.xxh3_128_digest((digests[-1] if digests else parent) + d))
                words.append(w)
            if len(rows) >= 4_096:
                yield out()
        if digests:
            close(True)
        if rows:
            yield out()

    TYPES = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return turns.select("conv_id", "idx", "digest", "words").repartition("conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(in_worker("trie")(run), CHAINS)


NODES = "digest binary, parent binary, depth int, conv_id long, n_convs long, words long"


def _turns_of(rows: DataFrame, block: int) -> DataFrame:
    """Each prefix that ends in a block: conv_id, n_convs (as given), digest, parent, depth, words."""
    place = F.sequence(F.lit(0), F.size("words") - 1)
    each = rows.select("conv_id", "n_convs", "block", "parent", "digests", "words", F.explode(place).alias("i"))
    part = lambda i: F.substring(F.col("digests"), i * 16 + 1, F.lit(16))
    return each.select("conv_id", "n_convs", part(F.col("i")).alias("digest"), F.when(F.col("i") == 0, F.col("parent")).otherwise(part(F.col("i") - 1)).alias("parent"), (F.col("block") * block + F.col("i") + 1).alias("depth"), F.get("words", F.col("i")).alias("words"))


def nodes_of(chains: DataFrame, n_convs: int, block: int = BLOCK) -> DataFrame:
    """NODES below the root: by block where a group stays together, by turn where it parts."""
    full = chains.where("full")
    groups = written(full.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).where("n > 1"), "groups")
    above = groups.select(F.col("key").alias("parent"), F.col("n").alias("n_above"))
    later = join_counted(chains.where("block > 0"), above, ["parent"], "n_above", "left").withColumn("n_above", F.coalesce("n_above", F.lit(1)))
    rows = later.unionByName(chains.where("block = 0").withColumn("n_above", F.lit(n_convs).cast("long")))
    blocks = join_counted(rows.where("full"), groups, ["key"], "n", "left").withColumns({"n": F.coalesce("n", F.lit(1)), "first": F.coalesce("first", "conv_id")})
    tails = rows.where("not full").withColumns({"n": F.when(F.col("n_above") == 1, F.lit(1)).otherwise(F.lit(0)).cast("long"), "first": F.col("conv_id")})
    marked = written(blocks.unionByName(tails).withColumn("together", F.col("n") == F.col("n_above")), "blocks")
    alone = _turns_of(marked.where("together and first = conv_id").withColumn("n_convs", F.col("n")), block)
    parted = _turns_of(marked.where("not together").withColumn("n_convs", F.lit(1).cast("long")), block)
    merged = parted.groupBy("digest").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("words").alias("words"))
    names = [x.split()[0] for x in NODES.split(", ")]
    out = written(merged.select(*names).unionByName(alone.select(*names)), "nodes")
    discard(groups, marked)
    return out


ENDS = "digest binary, ends_sha256 string"


def _hash_ends(batches):
    """Over rows sorted by digest and conv_id: the hash of each digest's ids; only its state is held."""
    digest, state = None, None
    for batch in batches:
        made = []
        for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if d != digest:
                if state is not None:
                    made.append((digest, state.hexdigest()))
                digest, state = d, hashlib.sha256(str(c).encode())
            else:
                state.update(f",{c}".encode())
        yield _ends(made)
    if state is not None:
        yield _ends([(digest, state.hexdigest())])


def _ends(made):
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in made], pa.binary()), pa.array([h for _, h in made], pa.string())], names=["digest", "ends_sha256"])


def prefix_trie(turns: DataFrame, conv_ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, idx, digest, words, the places of a conversation's turns
    without gaps; conv_ids: the distinct ids of all conversations, those without
    turns as well, which are members of the root alone. Conversations with equal
    turns end at one node. Without conversations there are no nodes.
    """
    spark = turns.sparkSession
    ids = written(conv_ids.select("conv_id"), "ids")
    smallest, n = ids.agg(F.min("conv_id"), F.count("*")).first()
    chains = written(chained(turns, block), "chains")
    root = spark.createDataFrame([(bytearray(ROOT), None, 0, smallest, n, 0)] if n else [], NODES)
    nodes = nodes_of(chains, n, block).unionByName(root)

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    value = (F.col("n_convs") - 1) * F.col("words")
    known = written(nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn("value", value), "known")
    leaf = (F.col("n_children") == 0).cast("long")
    owners = known.groupBy("conv_id").agg(F.min("depth").alias("from_depth"), F.sum("value").alias("value"), F.sum(leaf).alias("leaves")).where("from_depth > 0")
    # what an owner's part holds, told to all above it
    place = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.col("block") * block + i + 1 < F.col("from_depth"))
    above = chains.join(owners, "conv_id").select("value", "leaves", "digests", F.explode(place).alias("i")).select(F.substring("digests", F.col("i") * 16 + 1, F.lit(16)).alias("digest"), "value", "leaves")
    to_root = owners.select(F.lit(bytearray(ROOT)).alias("digest"), "value", "leaves")
    told = above.unionByName(to_root).groupBy("digest").agg(F.sum("value").alias("told_value"), F.sum("leaves").alias("told_leaves"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = known.withColumns({"own_value": F.sum("value").over(down), "own_leaves": F.sum(leaf).over(down)})

    turned = chains.where("last").select(F.col("key").alias("digest"), "conv_id")
    none = ids.join(turned.select("conv_id"), "conv_id", "left_anti").select(F.lit(bytearray(ROOT)).alias("digest"), "conv_id")
    ends = turned.unionByName(none).repartition("digest").sortWithinPartitions("digest", "conv_id").mapInArrow(in_worker("trie")(_hash_ends), ENDS)

    full = own.join(told, "digest", "left").join(ends, "digest", "left")
    full = full.select(
        "parent", "conv_id", "depth", "n_convs", "n_children",
        (F.col("own_leaves") + F.coalesce("told_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("own_value") + F.coalesce("told_value", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    parents = known.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_below"))
    below = join_counted(full.where("parent is not null"), parents, ["parent"], "n_below").select("parent_conv_id", *full.columns[1:])
    out = below.unionByName(full.where("parent is null").select(F.lit(None).cast("long").alias("parent_conv_id"), *full.columns[1:]))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import table

    turns = written(turn_digests(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")), "turns")
    return prefix_trie(with_shared_heads(turns), turns.where("idx = 0").select("conv_id"))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS idx
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, t.idx, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.idx < c.h
  UNION ALL SELECT c.conv_id, t.idx, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.idx >= c.h
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS depth, role, text FROM r
), l AS (
  SELECT c.conv_id, coalesce(x.turns, []) AS turns FROM c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY depth) AS turns FROM s GROUP BY conv_id) x USING (conv_id)
), p AS (
  SELECT conv_id, len(turns) AS size, d AS depth, sha256(CAST(to_json(turns[1:d]) AS VARCHAR)) AS node, CASE WHEN d > 0 THEN sha256(CAST(to_json(turns[1:d - 1]) AS VARCHAR)) END AS parent,
         CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM l, unnest(range(0, len(turns) + 1)) AS u(d)
), n AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS value,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM p GROUP BY node
), k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
a AS (SELECT DISTINCT x.node AS top, y.node FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
b AS (SELECT a.top AS node, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum(f.value) AS saved_tokens FROM a JOIN f ON a.node = f.node GROUP BY a.top)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN b USING (node) LEFT JOIN n g ON f.parent = g.node
"""
