"""The life of memories: saving, searching, ranking, merging, ageing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blocklist_reason, content_hash, episode_value, noise_reason
from ..functions.vector import cosine, hashed, literal, unit
from ..storage import cut
from .filters import keep_first
from .rounds import settle_apart, settle_pairs
from .transcripts import build, classify

LEAST, MOST = 0.05, 0.99
DAY = 86_400_000_000


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), value))


# Confidence that a memory of a type starts with.
INITIAL = {"MISTAKE": 0.65, "PREFERENCE": 0.55, "KNOWLEDGE": 0.50, "PATTERN": 0.60, "FEEDBACK": 0.45, "A2A_SHARED_CONTEXT": 0.40}


def initial_confidence(memory_type: Column, importance: Column) -> Column:
    base = reduce(lambda rest, kv: F.when(memory_type == kv[0], kv[1]).otherwise(rest), INITIAL.items(), F.lit(0.50))
    return clamp(base + F.when(importance >= 9, 0.25).when(importance >= 7, 0.15).when(importance <= 3, -0.15).otherwise(0.0))


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def whole_days(since: Column, as_of: Column) -> Column:
    return F.floor((micros(as_of) - micros(since)) / DAY)


def vector_topk(df: DataFrame, query: Sequence[float], k: int, key: str = "id", embedding: str = "embedding", weight: float = 1.0) -> DataFrame:
    """The k rows most similar to query, as (key, score); rows without a vector never count. Ties: by key."""
    scored = df.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).select(key, (cosine(F.col(embedding), literal(query)) * weight).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def rerank_score(base: Column, as_of: Column, scope: str | None = None) -> Column:
    """base plus what confidence, evidence, scope, age and importance add."""
    evidence = F.coalesce(F.col("evidence_count"), F.lit(0))
    near = F.when(F.col("scope") == scope, 0.30).when(F.col("scope").startswith(f"{scope}/"), 0.15).otherwise(0.0) if scope else F.lit(0.0)
    age = (micros(as_of) - micros(F.col("created_at"))) / DAY
    return (
        base
        + 0.20 * F.coalesce(F.col("confidence"), F.lit(0.5))
        + F.when(evidence > 0, 0.05 * F.least(F.lit(1.0), F.log2(evidence + 1) / 5)).otherwise(0.0)
        + near
        + 0.15 * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), age / 90)))
        + 0.10 * F.coalesce(F.col("importance"), F.lit(0)) / 10
    )


def search_memories(memories: DataFrame, query: Sequence[float] | None, as_of, limit: int, offset: int = 0, *, scope: str | None = None, similarity_weight: float = 0.5, gate_first: bool = False) -> DataFrame:
    """A page of filtered memories, ranked by rerank_score, or the newest first without a query. Blocklisted ones are dropped after paging, or before it."""
    rows = memories.where(blocklist_reason(F.col("content")).isNull()) if gate_first else memories
    if query is None:
        rows = rows.withColumn("score", F.lit(None).cast("double")).orderBy(F.desc("created_at"), "id")
    else:
        base = cosine(F.col("embedding"), literal(query)) * similarity_weight
        rows = rows.where(F.size("embedding") > 0).withColumn("score", rerank_score(base, F.lit(as_of), scope)).orderBy(F.desc("score"), "id")
    rows = rows.offset(offset).limit(limit)
    return rows if gate_first else rows.where(blocklist_reason(F.col("content")).isNull())


def with_saved_fields(drafts: DataFrame, as_of) -> DataFrame:
    """Drafts that pass the noise gate, with hash, confidence and id."""
    kept = drafts.where(noise_reason(F.col("content"), F.col("memory_type"), F.col("importance")).isNull())
    millis = F.unix_millis(F.lit(as_of).cast("timestamp"))
    return kept.withColumns(
        {
            "content_hash": content_hash(F.col("content")),
            "confidence": initial_confidence(F.col("memory_type"), F.col("importance")),
            "id": F.concat_ws("_", "project", "memory_type", "session_id", millis),
        }
    )


MEMORY_KEY = ("project", "memory_type", "content_hash", "tenant_id")


def upsert_merge(stored: DataFrame, batch: DataFrame, order: str = "created_at") -> DataFrame:
    """Memories after a batch: equal keys merge. The largest importance and confidence stay, evidence adds up, the latest content, session and id win, as do the latest scope, tags and relations that aren't null.

    Both sides are aggregated once by key, so that a batch may hold a key many times.
    """
    columns = [c for c in stored.columns if c not in MEMORY_KEY]
    rows = stored.withColumn("_seq", F.struct(F.lit(0).alias("side"), F.col(order).alias("at"))).unionByName(
        batch.withColumns({"evidence_count": F.lit(1).cast("long"), "_seq": F.struct(F.lit(1).alias("side"), F.col(order).alias("at"))}), allowMissingColumns=True
    )
    latest_known = {"scope", "tags", "related_ids"}
    special = {"importance": F.max("importance"), "confidence": F.max("confidence"), "evidence_count": F.sum("evidence_count"), "created_at": F.min("created_at")}
    made = []
    for c in columns:
        if c in special:
            made.append(special[c].alias(c))
        elif c in latest_known:
            made.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c))
        else:
            made.append(F.max_by(c, "_seq").alias(c))
    return rows.groupBy(*MEMORY_KEY).agg(*made).select(*stored.columns)


def keep_latest(df: DataFrame, sequence: str, keys: Sequence[str] = MEMORY_KEY, hashed: str = "content_hash") -> DataFrame:
    """The row with the largest sequence of each key; rows without a hash all stay."""
    known = keep_first(df.where(F.col(hashed).isNotNull()), keys, F.desc(sequence))
    return known.unionByName(df.where(F.col(hashed).isNull()))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], latest: str | None = None) -> DataFrame:
    """old with the rows of new in place of equal keys."""
    new = keep_first(new, keys, F.desc(latest)) if latest else new.dropDuplicates(list(keys))
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def bump(df: DataFrame, ids: DataFrame, counter: str, key: str = "id", at: str | None = None, as_of=None) -> DataFrame:
    """counter one higher, and at set, on the rows with these ids."""
    hit = ids.select(F.col(key).alias("_hit")).distinct()
    joined = df.join(hit, F.col(key) == F.col("_hit"), "left")
    made = {counter: F.coalesce(F.col(counter), F.lit(0)) + F.when(F.col("_hit").isNotNull(), 1).otherwise(0)}
    if at:
        made[at] = F.when(F.col("_hit").isNotNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col(at))
    return joined.withColumns(made).drop("_hit")


def reassign_tenant(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn("tenant_id", F.when(F.col("tenant_id") == old, new).otherwise(F.col("tenant_id")))


def update_fields(df: DataFrame, condition: Column, values: dict) -> DataFrame:
    """Sets the fields that have a value, where condition holds; raises version if there is one."""
    made = {c: F.when(condition, F.lit(v)).otherwise(F.col(c)) for c, v in values.items() if v is not None}
    if made and "version" in df.columns:
        made["version"] = F.when(condition, F.col("version") + 1).otherwise(F.col("version"))
    return df.withColumns(made)


def delete_ids(df: DataFrame, ids: DataFrame, tenant: str) -> DataFrame:
    return df.join(ids.select("id").withColumn("tenant_id", F.lit(tenant)), ["id", "tenant_id"], "left_anti")


def lifecycle(df: DataFrame, as_of) -> DataFrame:
    """Confidence after decay, evidence and access, then status: each step sees what the one before made."""
    now = F.lit(as_of).cast("timestamp")
    status = F.coalesce("status", F.lit("active"))
    live = status == "active"
    c = F.coalesce("confidence", F.lit(0.5)).cast("double")
    fade = F.when(F.col("last_accessed_at").isNotNull(), F.pow(F.lit(0.995), whole_days(F.col("last_accessed_at"), now))).otherwise(F.pow(F.lit(0.997), whole_days(F.col("created_at"), now)))
    evidence, access = F.coalesce("evidence_count", F.lit(0)), F.coalesce("access_count", F.lit(0))
    out = df.withColumn("_c0", F.when(live, F.greatest(F.lit(LEAST), c * fade)).otherwise(c))
    out = out.withColumn("_c1", F.when(live & (evidence > 1), clamp(F.col("_c0") + 0.05 * F.log2(evidence + 1))).otherwise(F.col("_c0")))
    out = out.withColumn("_c2", F.when(live & (access > 0), clamp(F.col("_c1") + 0.02 * F.log2(access + 1))).otherwise(F.col("_c1")))
    return out.withColumns({"confidence": F.col("_c2"), "status": F.when(live & (F.col("_c2") < 0.10), "archived").otherwise(status)}).drop("_c0", "_c1", "_c2")


def concept_confidence(confidence: Column, evidence: Column) -> Column:
    """Raised by evidence; changes of up to 0.01 aren't made."""
    raised = F.least(F.lit(MOST), confidence + (1 - confidence) * (1 - F.exp(-0.2 * evidence)))
    return F.when(F.abs(raised - confidence) > 0.01, raised).otherwise(confidence)


#: Vectors that the others are placed by, members of a block, vectors compared with a block at a time, and visitors that one task compares with a block.
PIVOTS, BLOCK, AT_ONCE, VISITORS = 64, 8_192, 512, 1_000_000


def _placed(unit: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """unit (with _u) and home, the nearest pivot, angle, the angle to it, and angles, those to all."""
    schema = T.StructType([*unit.schema.fields, *T.StructType.fromDDL("home int, angle double, angles array<double>").fields])
    at = unit.columns.index("_u")

    def run(batches):
        for batch in batches:
            homes, near, every = [], [], []
            for v in batch.column(at):
                u = np.asarray(v.values.to_numpy(zero_copy_only=False))
                angles = np.arccos(np.clip(pivots[len(u)] @ u, -1, 1)) if len(u) in pivots else np.zeros(1)
                homes.append(int(angles.argmin()))
                near.append(float(angles.min()))
                every.append(angles.tolist())
            made = [pa.array(homes, pa.int32()), pa.array(near, pa.float64()), pa.array(every, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f.name for f in schema.fields])

    return unit.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _compare_blocks(threshold: float, schema: T.StructType, group: Sequence[str]):
    """Over rows sorted by _block and _visitor: the members of a block come first, and each visitor is compared with all of them."""
    names = [f.name for f in schema.fields]

    def run(batches):
        block, held, members = None, [], None
        for batch in batches:
            blocks = batch.column(names.index("_block")).dictionary_encode()
            keys = blocks.indices.to_numpy()
            visits = batch.column(names.index("_visitor")).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (visits[1:] != visits[:-1])]))
            for a, b in zip(edges, [*edges[1:], len(keys)]):
                part = batch.slice(a, b - a)
                if (here := blocks.dictionary[int(keys[a])].as_py()) != block:
                    block, held, members = here, [], None
                if not visits[a]:
                    held.append(part)
                    continue
                if members is None:
                    members = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
                if members is None:
                    continue
                m = _matrix(members.column(names.index("_u")))
                for low in range(0, b - a, AT_ONCE):
                    some = part.slice(low, AT_ONCE)
                    product = _matrix(some.column(names.index("_u"))) @ m.T
                    i, j = np.nonzero(product > threshold)
                    x, y = some.take(pa.array(i)), members.take(pa.array(j))
                    rx, ry = x.column(names.index("_r")).to_numpy(), y.column(names.index("_r")).to_numpy()
                    alike = x.column(names.index("home")).to_numpy() == y.column(names.index("home")).to_numpy()
                    # two of one home visit each other, others only one the other
                    keep = pa.array((rx < ry) | ((rx > ry) & ~alike))
                    first = pa.array(rx < ry).filter(keep)
                    kx, ky = x.column(names.index("_k")).filter(keep), y.column(names.index("_k")).filter(keep)
                    columns = [x.column(names.index(g)).filter(keep) for g in group]
                    pairs = [pc.if_else(first, kx, ky), pc.if_else(first, ky, kx)]
                    yield pa.RecordBatch.from_arrays([*columns, *pairs, pa.array(product[i, j]).filter(keep)], names=[*group, "earlier", "later", "similarity"])

    return run


def similar_pairs(df: DataFrame, group: Sequence[str], order: Sequence[str], threshold: float, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """Pairs within a group whose cosine exceeds threshold, as (earlier, later, similarity), by order and key; all of them.

    Vectors are placed at the nearest of PIVOTS vectors. Angles obey the triangle
    inequality, so that a vector need only be compared with the members of such
    pivots whose farthest member is no farther from the pivot than the vector
    itself less the angle allowed. Each pivot's members are cut into blocks of
    bounded size, each vector visits the blocks that it has to, and a task holds
    one block and streams its visitors by it. Vectors without length, and of
    unlike sizes, are like none; neither are those of a null group.
    """
    group = list(group)
    rows = df.where(F.size(embedding) > 0).select(*group, *(c for c in order if c not in group), F.col(key).alias("_k"), F.col(embedding).alias("_v"))
    # places in the order: numbers that grow with it, by a sort by range; lengths are computed behind it, as it reads its input twice
    placed = rows.orderBy(*order, "_k").select(*group, F.monotonically_increasing_id().alias("_r"), "_k", unit(F.col("_v")).alias("_u"))
    units = cut(placed.where("_u is not null"))
    by_size: dict[int, list] = {}
    for r in units.select("_u").orderBy(F.xxhash64("_k"), "_k").limit(PIVOTS).collect():
        by_size.setdefault(len(r["_u"]), []).append(r["_u"])
    placed = cut(_placed(units, {n: np.array(vs) for n, vs in by_size.items()}).withColumn("_size", F.size("_u")))
    homes = placed.groupBy(*group, "_size", "home").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    in_group = homes.groupBy(*group, "_size").agg(F.collect_list(F.struct("home", "radius", parts.alias("blocks"))).alias("homes"), F.ceil(F.sum("n") / VISITORS).cast("int").alias("salts"))
    located = placed.join(in_group, [*group, "_size"])
    mixed = lambda n, seed: F.pmod(F.xxhash64("_k", F.lit(seed)), n).cast("int")
    fields = [*group, "_r", "_k", "_u", "home"]
    own = F.element_at(F.filter("homes", lambda h: h["home"] == F.col("home")), 1)["blocks"]
    members = located.select(*fields, "_size", F.col("home").alias("_at"), mixed(own, 1).alias("_part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"), F.lit(False).alias("_visitor"))
    most = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    reached = F.filter("homes", lambda h: (h["home"] >= F.col("home")) & (F.get(F.col("angles"), h["home"]) - most <= h["radius"]))
    visits = located.select(*fields, "_size", mixed(F.col("salts"), 2).alias("_salt"), F.explode(reached).alias("_h"))
    visits = visits.select(*fields, "_size", F.col("_h.home").alias("_at"), F.explode(F.sequence(F.lit(0), F.col("_h.blocks") - 1)).alias("_part"), "_salt", F.lit(True).alias("_visitor"))
    both = members.unionByName(visits).withColumn("_block", F.to_json(F.struct(*group, "_size", "_at", "_part", "_salt"))).select("_block", "_visitor", *fields)
    kinds = dict(df.dtypes)
    made = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), f"earlier {kinds[key]}, later {kinds[key]}, similarity double"])
    ordered = both.repartition("_block").sortWithinPartitions("_block", "_visitor")
    return ordered.mapInArrow(_compare_blocks(threshold, both.schema, group), made)


def superseded_ids(df: DataFrame, threshold: float = 0.85, group: Sequence[str] = ("tenant_id", "project", "memory_type"), pairs_of=similar_pairs) -> DataFrame:
    """(id, superseded_by) of active memories with a later, similar and more confident one; of several the first.

    pairs_of: similar_pairs, or lsh.similar_pairs_hashed where vectors are spread.
    """
    live = df.where("coalesce(status, 'active') = 'active'")
    pairs = pairs_of(live, group, ("created_at",), threshold)
    facts = live.select("id", "confidence", "created_at")
    a, b = facts.selectExpr("id as earlier", "confidence as c1"), facts.selectExpr("id as later", "confidence as c2", "created_at as at2")
    won = pairs.join(a, "earlier").join(b, "later").where("c2 > c1")
    return won.groupBy(F.col("earlier").alias("id")).agg(F.min_by("later", F.struct("at2", "later")).alias("superseded_by"))


#: Memories of a group that take their turns together, at least, places that are counted at a time (a power of two), and later memories that a task compares with them.
TURNS, PLACES, LATER = 4_096, 11, 16_384


def _in_turn(threshold: float):
    """Over a group's first memories: those that are left when all had their turns are open, the others are gone."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        u, w = _matrix(rows.column("unit").combine_chunks()), rows.column("weight").to_numpy()
        left = np.ones(len(w), bool)
        for x in range(len(w)):
            if not left[x]:
                continue
            like = np.flatnonzero((u[x + 1 :] @ u[x] > threshold) & left[x + 1 :]) + x + 1
            more = like[w[like] > w[x]] if w[x] >= 0 else like[:0]
            if len(more):
                left[x] = False
                like = like[like < more[0]]
            left[like] = False
        return pa.table({"rank": rows.column("rank"), "open": pa.array(left)})

    return run


def _touched(threshold: float):
    """Pairs (a, b, up) of memories that had their turn and later ones that they are similar to."""

    def run(later: pa.Table, turned: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        if len(later) and len(turned):
            (u, r, w), (v, a, x) = ((_matrix(t.column("unit").combine_chunks()), t.column("rank").to_numpy(), t.column("weight").to_numpy()) for t in (later, turned))
            for low in range(0, len(r), AT_ONCE):
                i, j = np.nonzero(u[low : low + AT_ONCE] @ v.T > threshold)
                i += low
                found.append((a[j], r[i], (w[i] > x[j]) & (x[j] >= 0)))
        return pa.table(dict(zip(("a", "b", "up"), map(np.concatenate, zip(*found)))))

    return run


def _by_turns(df: DataFrame, threshold: float, group: Sequence[str], embedding: str = "embedding") -> DataFrame:
    """ids that greedy_duplicates removes, by few of all similar pairs.

    The first memories of each group take their turns in a task. Those that are
    still there, which are unlike each other, are compared with all later ones,
    and what they leave goes on with its first memories. What is left is unlike
    all that had their turn, and so is soon little where many are alike: rounds
    grow with the logarithm of a group then, and comparisons with its size. Where
    few are alike, the rest is compared in pairs.
    """
    keys = [*group, "_size"]
    known = reduce(lambda a, b: a & b, (F.col(g).isNotNull() for g in group), F.lit(True))
    rows = df.where(known & (F.size(embedding) > 0))
    weights = df.select("importance").where("importance is not null").distinct().orderBy("importance").select("importance", F.monotonically_increasing_id().alias("weight"))
    rows = rows.select(*group, "id", "importance", "created_at", F.col(embedding).alias("_v")).join(weights, "importance", "left")
    # lengths are computed behind the sort, which reads its input twice
    rows = rows.orderBy("created_at", "id").select(*group, F.size("_v").alias("_size"), "id", F.monotonically_increasing_id().alias("rank"), F.coalesce("weight", F.lit(-1)).alias("weight"), unit(F.col("_v")).alias("unit"))
    every = cut(rows.where("unit is not null"))
    left, removed = every.drop("id"), []
    place = F.shiftright("rank", PLACES)
    while True:
        counted = left.groupBy(*keys, place.alias("_place")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = F.max(F.when(F.col("before") < TURNS, F.col("_place"))).alias("_last")
        places = cut(counted.withColumn("before", before).groupBy(*keys).agg(last, F.sum(F.when(F.col("before") >= TURNS, F.col("n")).otherwise(0)).alias("later"), F.sum("n").alias("n")))
        n, later = places.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("later"), F.lit(0))).first()
        if not n:
            break
        located = left.join(places.withColumn("_parts", F.ceil(F.col("later") / LATER).cast("int")).drop("n", "later"), keys)
        first = located.where(place <= F.col("_last"))
        turned = cut(first.select(*keys, "rank", "weight", "unit").groupBy(*keys).applyInArrow(_in_turn(threshold), "rank long, open boolean"))
        removed.append(turned.where("not open").select(F.col("rank").alias("node")))
        if not later:
            break
        parts = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
        stay = cut(first.where("_parts > 0").join(turned.where("open").select("rank"), "rank", "left_semi").select(*keys, "_parts", "rank", "weight", "unit"))
        stay = stay.select(*keys, parts, "rank", "weight", "unit")
        rest = located.where(place > F.col("_last"))
        dealt = rest.select(*keys, F.pmod(F.xxhash64("rank"), "_parts").cast("int").alias("_part"), "rank", "weight", "unit")
        pairs = dealt.groupBy(*keys, "_part").cogroup(stay.groupBy(*keys, "_part")).applyInArrow(_touched(threshold), "a long, b long, up boolean")
        gone = cut(settle_apart(pairs))
        removed.append(gone)
        left = cut(rest.join(gone.select(F.col("node").alias("rank")), "rank", "left_anti").select(*left.columns))
        if left.count() > 0.75 * n and 2 * turned.where("open").count() > n - later:
            pairs = similar_pairs(left, group, ("rank",), threshold, "unit", "rank")
            removed.append(settle_pairs(_with_up(pairs, left.select("rank", "weight")))[0])
            break
    if not removed:
        return every.select("id")
    return every.join(reduce(DataFrame.unionByName, removed).distinct().select(F.col("node").alias("rank")), "rank", "left_semi").select("id")


def _with_up(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """(a, b, up) of (earlier, later), which are ranks: up where the later one weighs more; -1 weighs nothing that is known."""
    a, b = ranked.selectExpr("rank as a", "weight as w1"), ranked.selectExpr("rank as b", "weight as w2")
    both = pairs.selectExpr("earlier as a", "later as b").join(a, "a").join(b, "b")
    return both.select("a", "b", F.expr("w1 >= 0 and w1 < w2").alias("up"))


def greedy_duplicates(df: DataFrame, threshold: float = 0.85, group: Sequence[str] = ("tenant_id", "project"), pairs_of=similar_pairs) -> DataFrame:
    """ids to remove: in order of (created_at, id) each kept memory removes later similar ones of no more importance, and is itself removed by the first of more.

    With another function for pairs than similar_pairs, those are found as a join,
    and settled in rounds: a memory takes its turn as soon as nothing earlier can
    still touch it or those it is similar to. Jobs run while this is called.
    """
    if pairs_of is similar_pairs:
        return _by_turns(df, threshold, list(group))
    pairs = cut(pairs_of(df, group, ("created_at",), threshold))
    ends = pairs.select(F.col("earlier").alias("id")).union(pairs.select(F.col("later").alias("id"))).distinct()
    facts = df.join(ends, "id", "left_semi").select("id", "importance", "created_at")
    ranked = cut(facts.orderBy("created_at", "id").select("id", "importance", F.monotonically_increasing_id().alias("rank")))
    a = ranked.selectExpr("id as earlier", "importance as i1", "rank as a")
    b = ranked.selectExpr("id as later", "importance as i2", "rank as b")
    removed, _ = settle_pairs(pairs.join(a, "earlier").join(b, "later").select("a", "b", F.coalesce(F.expr("i1 < i2"), F.lit(False)).alias("up")))
    return ranked.join(removed.select(F.col("node").alias("rank")), "rank", "left_semi").select("id")


def concept_clusters(df: DataFrame, group: Sequence[str] = ("project", "memory_type"), least: int = 2, total: int = 3, show: int = 5) -> DataFrame:
    """size, the first contents joined, and ids of each cluster; none where there are fewer than total rows in all. Only the contents that are shown move."""
    first = keep_first(df.select(*group, "created_at", "id", "content"), group, "created_at", "id", most=show)
    shown = F.array_sort(F.collect_list(F.struct("created_at", "id", "content")))
    first = first.groupBy(*group).agg(F.array_join(F.transform(shown, lambda x: x["content"]), " | ").alias("summary"))
    ids = F.array_sort(F.collect_list(F.struct("created_at", "id")))
    out = df.groupBy(*group).agg(F.count("*").alias("size"), F.transform(ids, lambda x: x["id"]).alias("source_ids")).where(F.col("size") >= least)
    enough = df.limit(total).agg((F.count("*") >= total).alias("_enough"))
    out = out.join(F.broadcast(enough), F.col("_enough"))  # one row, which is true or false
    same = reduce(lambda a, b: a & b, (out[g].eqNullSafe(first[g]) for g in group))
    return out.join(first, same).select(*(out[g] for g in group), "size", "summary", "source_ids")


def concepts_of(clusters: DataFrame, embed=None) -> DataFrame:
    """Drafts of concepts from clusters, with an embedding of label and description if embed makes vectors of texts; those without a vector then are left out."""
    label = F.substring(F.concat(F.lit("Pattern: "), "memory_type", F.lit(" in "), "project"), 1, 255)
    made = clusters.withColumns({"label": label, "confidence": F.lit(0.70), "evidence_count": F.col("size").cast("long"), "status": F.lit("active")})
    made = made.withColumn("id", F.sha2(F.concat_ws("|", "project", "memory_type", F.array_join("source_ids", ",")), 256)).withColumnRenamed("summary", "description").drop("size")
    return made if embed is None else made.withColumn("embedding", embed(F.concat("label", F.lit(": "), "description"))).where("embedding is not null")


def outcome_memory(outcome: Column, payload: Column) -> tuple[Column, Column]:
    """(content as JSON, importance) of a reported outcome."""
    return F.to_json(F.struct(outcome.alias("outcome"), payload.alias("details"))), F.when(outcome == "failure", 10).when(outcome == "success", 5).otherwise(3)


#: Memories that a context shows at most.
SHOWN = 100


def context_block(df: DataFrame, header: str = "## Relevant memories", most: int = SHOWN) -> DataFrame:
    """One row, context: a line for each memory, the highest score first, of the best most ones."""
    df = df.orderBy(F.desc("score"), "id").limit(most)
    line = F.concat(F.lit("- ["), "memory_type", F.lit("] ("), F.format_string("%.2f", F.col("score")), F.lit(") "), "content")
    lines = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", line.alias("line"))))
    return df.agg(F.concat_ws("\n", F.lit(header), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("context"))


def session_context(df: DataFrame, header: str = "# Session context", most: int = SHOWN) -> DataFrame:
    """One row, context: a paragraph for each memory that isn't blocklisted, of the most important most ones."""
    df = df.where(blocklist_reason(F.col("content")).isNull()).orderBy(F.desc("importance"), "id").limit(most)
    block = F.concat(F.lit("### "), "memory_type", F.lit(" ("), F.col("importance").cast("int").cast("string"), F.lit(")\n"), "content")
    blocks = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("s"), "id", block.alias("block"))))
    return df.agg(F.concat_ws("\n\n", F.lit(header), F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n")).alias("context"))


def importance_of(value: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(9), value)), F.lit(5))


def valid_scope(scope: Column) -> Column:
    """Letters, digits, slashes and dashes in lower case, 500 at most; none at all is fine."""
    return scope.isNull() | (scope == "") | scope.rlike("^[a-z0-9][a-z0-9/-]{0,499}\\z")


def valid_list(values: Column, most: int = 100) -> Column:
    """At most so many texts of at most so many characters; null is fine."""
    return F.coalesce((F.size(values) <= most) & F.forall(values, lambda x: x.isNotNull() & (F.length(x) <= most)), F.lit(True))


def usable_vectors(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: how many rows have a vector to compare, and how many are skipped."""
    has = F.coalesce(F.size(embedding) > 0, F.lit(False))
    return df.agg(F.count_if(has).alias("usable"), F.count_if(~has).alias("skipped"))


def shared_context(key: Column, value: Column, visibility: Column, at: Column) -> dict[str, Column]:
    """The fields of a memory that shares a value with other agents."""
    content = F.to_json(F.struct(key.alias("key"), value.alias("value"), visibility.alias("visibility"), at.alias("timestamp")))
    return {"memory_type": F.lit("A2A_SHARED_CONTEXT"), "content": content, "importance": F.lit(5)}


def episodes(df: DataFrame, tenant: str, project: str, event_type: str | None = None, limit: int = 50) -> DataFrame:
    """A project's episodes, of one type if given, the newest first, and what their data hold."""
    rows = df.where((F.col("tenant_id") == tenant) & (F.col("project_name") == project))
    rows = rows.where(F.col("event_type") == event_type) if event_type else rows
    return rows.orderBy(F.desc("created_at"), "id").limit(limit).withColumn("value", episode_value(F.col("event_data")))


def search_concepts(concepts: DataFrame, query: Sequence[float], as_of, limit: int = 10, project: str | None = None, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(the nearest active concepts with score, all concepts after those were marked as accessed)."""
    rows = concepts.where("status = 'active'")
    rows = rows.where(F.col("project") == project) if project else rows
    found = cut(vector_topk(rows, query, max(1, min(limit, most))))
    ranked = concepts.join(F.broadcast(found), "id").orderBy(F.desc("score"), "id")  # most rows at most
    return ranked, bump(concepts, found, "access_count", at="last_accessed_at", as_of=as_of)


def remove_project(tables: dict[str, DataFrame], project: str, tenant: str) -> dict[str, DataFrame]:
    """The tables without a project's rows of a tenant; the project is called project or project_name."""
    out = {}
    for name, df in tables.items():
        column = "project_name" if "project_name" in df.columns else "project"
        out[name] = df.where(~(F.col(column).eqNullSafe(project) & F.col("tenant_id").eqNullSafe(tenant)))
    return out


def write_counts(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys of new an upsert inserts into old, and how many it updates."""
    both = new.select(*keys).distinct().join(old.select(*keys).distinct().withColumn("_known", F.lit(True)), list(keys), "left")
    return both.agg(F.count_if(F.col("_known").isNull()).alias("inserted"), F.count_if("_known").alias("updated"))


def ingest(stored: DataFrame, turns: DataFrame, tenant: str, as_of) -> tuple[DataFrame, DataFrame]:
    """(memories after sessions were read, one row of extracted, blocked and saved): extract, gate, merge.

    A session's texts (conv_id, turn, role, text) give drafts of memories; those
    that pass the noise gate are merged into the stored ones by their key.
    """
    drafts = classify(build(turns)).select(F.col("conv_id").cast("string").alias("session_id"), "memory_type", "content", F.col("importance").cast("double").alias("importance"))
    drafts = drafts.withColumns({"project": F.lit("sessions"), "tenant_id": F.lit(tenant)})
    drafts = cut(drafts.withColumn("reason", noise_reason(F.col("content"), F.col("memory_type"), F.col("importance"))))
    made = with_saved_fields(drafts.drop("reason"), as_of).withColumn("created_at", F.lit(as_of).cast("timestamp"))
    counts = drafts.agg(F.count("*").alias("extracted"), F.count_if(F.col("reason").isNotNull()).alias("blocked"), F.count_if(F.col("reason").isNull()).alias("saved"))
    return upsert_merge(stored, made.select(*[c for c in stored.columns if c in made.columns])), counts


@dataclass
class Consolidated:
    """memories and concepts after a job, and its report: step, n, error (null where a step went well)."""

    memories: DataFrame
    concepts: DataFrame
    report: DataFrame


#: The steps of a job, in this order.
STEPS = ("dedup", "extract_concepts", "score_concepts", "score_memories")
REPORT = "step string, n long, error string"


def run_consolidation(memories: DataFrame, as_of, threshold: float = 0.85, concepts: DataFrame | None = None, steps: Sequence[str] = STEPS, embed=None, pairs_of=None) -> Consolidated:
    """A job over memories (and concepts that there are already): duplicates go, concepts are made and scored, memories age and are superseded.

    Each step's result is written before the next one starts, so that it is
    computed once and a step that fails is in the report with its error while the
    others go on with what there was. The report counts the memories processed,
    rows that have no vector to compare, duplicates removed, concepts made and
    raised, memories archived and superseded. embed: a function of a concept's
    text that gives its vector (vector.hashed if none). Jobs run while this is
    called.
    """
    spark = memories.sparkSession
    pairs_of = pairs_of or similar_pairs
    columns = memories.columns
    rows, errors, counts = cut(memories), {}, {}
    made = None if concepts is None else cut(concepts)
    counts["processed"], counts["skipped_vectors"] = rows.count(), usable_vectors(rows).first()["skipped"]

    def dedup():
        nonlocal rows
        kept = cut(rows.join(greedy_duplicates(rows, threshold, pairs_of=pairs_of), "id", "left_anti").select(*columns))
        counts["duplicates_removed"] = counts["processed"] - kept.count()
        rows = kept

    def extract_concepts():
        nonlocal made
        new = cut(concepts_of(concept_clusters(rows.where(F.size("embedding") > 0)), embed or hashed))
        counts["concepts_made"] = new.count()
        made = new if made is None else cut(made.unionByName(new, allowMissingColumns=True))

    def score_concepts():
        nonlocal made
        if made is None:
            return
        scored = cut(made.withColumn("_before", F.col("confidence")).withColumn("confidence", concept_confidence(F.coalesce("confidence", F.lit(0.5)), F.coalesce("evidence_count", F.lit(1)))))
        counts["concepts_raised"] = scored.where(~F.col("confidence").eqNullSafe(F.col("_before"))).count()
        made = scored.drop("_before")

    def score_memories():
        nonlocal rows
        aged = cut(lifecycle(rows.withColumn("_was", F.col("status")), as_of))
        late = superseded_ids(aged, threshold, pairs_of=pairs_of).select("id", F.col("superseded_by").alias("_by"))
        aged = aged.drop("superseded_by_id").join(late, "id", "left")
        rows = cut(aged.withColumn("status", F.when(F.col("_by").isNotNull(), "superseded").otherwise(F.col("status"))).withColumnRenamed("_by", "superseded_by_id"))
        late_gone = (F.col("status") == "archived") & (F.coalesce("_was", F.lit("active")) != "archived")
        done = rows.agg(F.count_if(late_gone).alias("archived"), F.count_if(F.col("superseded_by_id").isNotNull()).alias("superseded")).first()
        counts.update(done.asDict())
        rows = rows.drop("_was")

    known = {"dedup": dedup, "extract_concepts": extract_concepts, "score_concepts": score_concepts, "score_memories": score_memories}
    for step in steps:
        try:
            known[step]()
        except Exception as error:  # a step of its own: the others go on
            errors[step] = f"{type(error).__name__}: {error}"[:1_000]
    if "superseded_by_id" not in rows.columns:
        rows = rows.withColumn("superseded_by_id", F.lit(None).cast(dict(memories.dtypes)["id"]))
    if made is None:
        made = concepts_of(concept_clusters(rows.limit(0)), embed or hashed)
    report = spark.createDataFrame([*((k, int(v), None) for k, v in counts.items()), *((k, None, e) for k, e in errors.items())], REPORT)
    return Consolidated(rows, made, report)
