"""N-gram Jaccard join as a grouped prefix join.

1. Each text becomes the sorted set of the hashes of its 5-word shingles. Texts
   with equal sets are linked at once; one of them stands for all.
2. Shingles are ordered by hash, but those that many documents have come last.
   Two sets whose Jaccard similarity reaches the threshold share an element of
   their prefixes, the first |x| - ceil(t |x|) + 1 elements in that order.
   Frequencies are counted over all documents, in packed lists of four bytes an
   element; the frequent shingles are bits of a bounded table. The order only
   decides how much work there is.
3. Documents with the same prefix and size are collapsed into one group. Pairs
   of groups that share a rare prefix element are filtered by their sizes and by
   how much of the prefixes is common. Groups that share a frequent element are
   chained by classes of sizes if the element's place in their order allows the
   threshold: a row for each group, never a pair for each two of them. Frequent
   elements stand late, where hardly a size is allowed. The components of pairs
   and chains are what has to be compared.
4. Groups are expanded, and the members of a component are verified on their
   whole sets, in one task if they are few. A large component is first compared
   with its smallest member; what that leaves is compared with all others in
   blocks of bounded size, a task for each pair of blocks. The pairs take turns,
   so that no more texts are on the way at once than a few times the candidates'.

Links come out as a spanning forest; its components are the classes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import KEPT_IN_WORKER, discard, in_worker, join_counted, release, written
from .graph import components

SHINGLE, THRESHOLD = 5, 80
#: Elements that a task meets more often than this among COUNTED of them come last in the order, and those met more than PAIRED times in all.
FREQUENT = 1
#: Lists by the leading bits of elements, in which they are counted by the SLOT bits that follow.
LISTS, SLOT = 10, 32
#: Bits of the table that says which: so many for each of them, as a power of two between these (128 KB and 16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 20, 27
#: Groups that an element may have for their pairs to be looked at; those of other elements are chained.
PAIRED = 8
#: Rows of prefix elements that are matched at once, as long as TURNS turns are enough.
MATCHED, TURNS = 1 << 23, 4
#: Elements that a task counts at a time (8 MB).
COUNTED = 1 << 20
#: Members, and elements of their sets, that one task compares in a component; members and elements of a block of larger ones.
TOGETHER, TOGETHER_ELEMENTS = 1_500, 750_000
BLOCK, BLOCK_ELEMENTS = 1_500, 750_000
#: Candidates that go to the texts (10 MB); of more, the texts go to them.
TRAVEL = 200_000
#: Texts that are on the way to pairs of blocks at once, as times all candidates' texts, by their elements.
MOVED = 2

BASE = 0x9E3779B97F4A7C15
SLICE = 1 << 20


_POWERS: dict[str, np.ndarray] = {}
KEPT_IN_WORKER["hashes"] = _POWERS


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, SLICE + (1 << 17))
        _POWERS["p"] = np.cumprod(np.full(size, BASE, np.uint64))
        _POWERS["i"] = np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), np.uint64))
    return _POWERS["p"][:n], _POWERS["i"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91] += 32
_KIND[0] = 65  # a number that no byte has any more
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def shingle_hashes(data: np.ndarray, ends: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts that lie in data one after another, and where each text's begin and end.

    Texts are UTF-8 with a separator after each; A-Z count as a-z; words are cut
    at white space. A text of fewer than k words, but not none, has one shingle.
    """
    low = _KIND[data]
    word = low != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    power, inverse = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power)])
    words = _mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    first = np.searchsorted(starts, np.concatenate([[0], ends]))  # of the words of each text
    n = np.diff(first)
    h = np.zeros(len(words), np.uint64)
    for i in range(k):
        part = np.zeros(len(words), np.uint64)
        part[: max(0, len(words) - i)] = words[i:]
        h = h * np.uint64(0xD6E8FEB86659FD93) + part
    h = _mix(h)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = h[np.repeat(first[:-1] - offsets[:-1], count) + np.arange(offsets[-1])]
    for i in np.flatnonzero((n > 0) & (n < k)):
        x = 0
        for w in words[first[i] : first[i + 1]]:
            x = (x * BASE + int(w)) & (2**64 - 1)
        out[offsets[i]] = x ^ (0xA5A5 + int(n[i]))
    return out, offsets


def sets_of(texts: pa.Array):
    """Yields (place, set as a sorted uint64 array) for each text; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n, at = len(texts), 0
    lengths = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.int64)
    while at < n:
        upto, size = at, 0
        while upto < n and (upto == at or size + lengths[upto] <= SLICE):
            size += lengths[upto] + 1
            upto += 1
        data = np.frombuffer(" ".join(texts.slice(at, upto - at).to_pylist()).encode() + b" ", np.uint8)
        hashes, offsets = shingle_hashes(data, np.cumsum(lengths[at:upto] + 1))
        owner = np.repeat(np.arange(upto - at), np.diff(offsets))
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        cut = np.searchsorted(owner, np.arange(upto - at + 1))
        for i in range(upto - at):
            yield at + i, hashes[cut[i] : cut[i + 1]]
        at = upto


def prefix_size(n: int, threshold: int) -> int:
    return n - math.ceil(threshold * n / 100) + 1 if n else 0


def _often(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether elements come last: the bit of an element's leading digits is set."""
    slot = s >> np.uint64(62 - len(bits).bit_length())
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _frequent(documents: DataFrame, threshold: int) -> np.ndarray:
    """A table of bits, one for each beginning of an element, set for frequent ones; counted over the stretch of each set from which prefixes come (twice their size).

    All documents are counted. What a task meets more than FREQUENT times among
    COUNTED elements is frequent at once. All else is counted over all tasks, as
    elements of more than PAIRED groups are chained if they stand early: the more
    tasks there are, the more of those does no task meet twice, and their chains
    would grow into each other until most documents are one component. Tasks
    send packed lists of slots. Elements that share a slot or a bit with a
    frequent one come last too, one in BITS_EACH of them or so; the order is right
    whatever the counts are. Tasks make the table's parts; MOST_BITS bits come to
    the driver at most.
    """
    often, most = FREQUENT, PAIRED + 1

    @in_worker("hashes")
    def stretch(batches):
        held, size = [], 0

        def lists():
            slots, c = np.unique(np.concatenate(held) >> np.uint64(64 - LISTS - SLOT), return_counts=True)
            slots = np.repeat(slots, np.where(c > often, most, np.minimum(c, most)))
            cut = np.searchsorted(slots, np.arange(1 << LISTS, dtype=np.uint64) << np.uint64(SLOT))
            packed = np.split(slots.astype(np.uint32), cut[1:])
            own = [i for i, x in enumerate(packed) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([packed[i].tobytes() for i in own], pa.binary())], names=["list", "slots"])

        for batch in batches:
            for _, s in sets_of(batch.column(0)):
                held.append(s[: 2 * prefix_size(len(s), threshold)])
                size += len(held[-1])
                if size >= COUNTED:
                    yield lists()
                    held, size = [], 0
        if held:
            yield lists()

    @in_worker("hashes")
    def frequent(batches):
        for table in _blocks_of_rows(batches, 0):
            keys, packed = table.column(0).to_numpy(), table.column(1).to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                slots, c = np.unique(np.frombuffer(b"".join(packed[a:b]), np.uint32), return_counts=True)
                found = (np.uint64(keys[a]) << np.uint64(SLOT) | slots[c >= most].astype(np.uint64)) << np.uint64(64 - LISTS - SLOT)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["e"])

    counts = documents.select("text").mapInArrow(stretch, "list long, slots binary").repartition("list").sortWithinPartitions("list")
    counts = written(counts.mapInArrow(frequent, "e long"), "frequent")
    power = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, counts.count() * BITS_EACH)))))
    size = 1 << (LEAST_BITS - 3)

    @in_worker("hashes")
    def parts(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - power)
            for part in np.unique(slots >> np.uint64(LEAST_BITS)):
                own = (slots[slots >> np.uint64(LEAST_BITS) == part] & np.uint64((1 << LEAST_BITS) - 1)).astype(np.int64)
                np.bitwise_or.at(made.setdefault(int(part), np.zeros(size, np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([m.tobytes() for m in made.values()], pa.binary())], names=["part", "bits"])

    bits = np.zeros(1 << (power - 3), np.uint8)
    by_part = counts.repartitionByRange(1 << (power - LEAST_BITS), "e") if power > LEAST_BITS else counts.coalesce(1)
    for r in by_part.mapInArrow(parts, "part long, bits binary").toLocalIterator():
        bits[r["part"] * size : (r["part"] + 1) * size] |= np.frombuffer(r["bits"], np.uint8)
    discard(counts)
    return bits


SETS = "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, last_often boolean, last long, prefix array<long>"


def _sums(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set or sequence of hashes."""
    place = np.arange(1, len(x) + 1, dtype=np.uint64)
    return int(_mix(x + place).sum(dtype=np.uint64).view(np.int64)), int((_mix(x ^ np.uint64(0x5851F42D4C957F2D)) * (place * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64).view(np.int64))


def shingle_sets(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A row per row of documents: doc_id, n, digests of the set and of its prefix, where the prefix ends in the global order, and the prefix."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(_frequent(documents, threshold))

    @in_worker("hashes")
    def run(batches):
        frequent = shared.value
        for batch in batches:
            rows = []
            for _, s in sets_of(batch.column(1)):
                n = len(s)
                size = prefix_size(n, threshold)
                often = _often(frequent, s)
                prefix = np.concatenate([s[~often], s[often]])[:size]
                end = int(prefix[-1]) if n else 0
                last_often = bool(n and size > n - often.sum())
                rows.append((n, *_sums(s), *_sums(prefix), last_often, end - (1 << 63), prefix.view(np.int64)))
            if rows:
                *numbers, prefixes = zip(*rows)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in numbers), listed], names=[x.split()[0] for x in SETS.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, SETS)


def _possible(pairs: DataFrame, many: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Drops pairs of groups that can't link, going by how many elements of their prefixes are common.

    All common elements up to the end of the prefix that ends first, in the
    global order, are counted in common, save those of more than PAIRED groups:
    of these no more can be common than either prefix has, which is in many. So
    of the set with that prefix no more can be common than those and what
    follows its prefix. Pairs with ids of several texts stay.
    """
    end = F.struct("n", "last_often", "last", F.size("prefix").alias("size"))
    ends = sets.groupBy(F.col("doc_id").alias("g")).agg(F.min(end).alias("end"), (F.min(end) != F.max(end)).alias("several"))
    ends = ends.join(many, "g", "left").withColumn("many", F.coalesce("many", F.lit(0)))
    named = lambda g, end: ends.select(F.col("g").alias(g), F.col("end").alias(end), F.col("several").alias(f"{end}_several"), F.col("many").alias(f"{end}_many"))
    both = pairs.join(named("a", "x"), "a").join(named("b", "y"), "b")
    at = lambda end: F.struct(end["last_often"].alias("often"), end["last"].alias("last"))
    x, y = F.col("x"), F.col("y")
    ends_first = F.when(at(x) <= at(y), x["n"] - x["size"]).otherwise(y["n"] - y["size"])
    needed = threshold * (x["n"] + y["n"])  # of (100 + threshold) * the number of common elements
    fits = (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * threshold) & ((F.col("common") + F.least("x_many", "y_many") + ends_first) * (100 + threshold) >= needed)
    return both.where(F.col("x_several") | F.col("y_several") | fits)


def _chains(heads: DataFrame, threshold: int) -> DataFrame:
    """a, b: chains of the groups that share an element of many groups and might link, going by their sizes.

    If it is the first common element of two sets, each can link only with
    sizes up to its own largest, and one that has no size left links with none.
    Sizes that link lie in one class or in neighbouring ones: each group is
    chained to the first of its class, and that to the first of the next class
    if a size of the class reaches it.
    """
    ratio = math.log(100 / threshold) if threshold < 100 else 1e-9
    some = heads.where(F.col("largest") * 100 >= F.col("n") * threshold).select("e", "g", "n", "largest", F.floor(F.log("n") / ratio).alias("class"))
    hubs = some.groupBy("e", "class").agg(F.min("g").alias("hub"), F.max("largest").alias("top"), F.min("n").alias("low"), F.count("*").alias("c"))
    hubs = written(hubs, "hubs")
    within = join_counted(some.select("e", "class", "g"), hubs.where("c > 1").select("e", "class", "hub", "c"), ["e", "class"], "c").where("g <> hub").select(F.col("g").alias("a"), F.col("hub").alias("b"))
    following = hubs.select("e", (F.col("class") - 1).alias("class"), F.col("hub").alias("b"), F.col("low").alias("next_low"))
    across = hubs.join(following, ["e", "class"]).where("top >= next_low and hub <> b").select(F.col("hub").alias("a"), "b")
    return within.unionByName(across)


def _candidates(sets: DataFrame, threshold: int) -> DataFrame:
    """doc_id, n, comp: the documents (one of each set) that have to be compared with others, by component."""
    one = sets.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    # equal prefixes and sizes are one group, named after its smallest member
    groups = one.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("g"), F.count("*").alias("members"))
    groups = written(groups, "groups")
    single = groups.where("members = 1").select(F.col("g").alias("doc_id"), "n", "g", "members")
    named = join_counted(one.select("doc_id", "n", "p1", "p2"), groups.where("members > 1"), ["n", "p1", "p2"], "members").select("doc_id", "n", "g", "members")
    named = written(named.unionByName(single), "named")
    discard(groups)
    heads = sets.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("g"), F.first("prefix").alias("prefix")).select("g", "n", F.posexplode("prefix").alias("i", "e"))
    # of two sets whose first common element is at i and j, each can only link with sizes up to its own largest: what comes before i has no partner
    heads = heads.select("e", "g", "n", F.floor(((100 + threshold) * (F.col("n") - F.col("i")) - threshold * F.col("n")) / threshold).alias("largest"))
    heads = written(heads, "heads")
    release(heads.sparkSession)
    turns = min(TURNS, 1 + heads.count() // MATCHED)
    matched = []
    for turn in range(turns):  # so that only a part of the elements is on its way at a time
        own = heads.where(F.pmod("e", F.lit(turns)) == turn)
        counts = written(own.groupBy("e").agg(F.count("*").alias("c")).where("c > 1"), "counts")
        release(heads.sparkSession)
        matched.append(written(join_counted(own, counts, ["e"], "c"), "shared"))
        discard(counts)
        release(heads.sparkSession)
    discard(heads)
    shared = reduce(DataFrame.unionByName, matched)
    # all pairs of the groups of a rare element; a pair counts once for each common element
    rare = shared.where(F.col("c") <= PAIRED).groupBy("e").agg(F.array_sort(F.collect_list("g")).alias("g"))
    pairs = rare.select("g", F.posexplode("g").alias("i", "a")).select("a", F.explode(F.slice("g", 1, F.col("i"))).alias("b")).where("a <> b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("common"))
    frequent = shared.where(F.col("c") > PAIRED)
    many = frequent.groupBy("g").agg(F.count("*").alias("many"))
    edges = _possible(pairs, many, sets, threshold).select("a", "b").unionByName(_chains(frequent, threshold))
    comps = components(edges)
    discard(*matched)
    release(shared.sparkSession)
    joined = named.join(comps, F.col("g") == F.col("node"), "left")
    return joined.where(F.col("component").isNotNull() | (F.col("members") > 1)).select("doc_id", "n", F.coalesce("component", "g").alias("comp"))


def _packed(documents: DataFrame) -> DataFrame:
    """doc_id and z: texts compressed, for the shuffles."""

    @in_worker("hashes")
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([pack((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), z], names=["doc_id", "z"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, z binary")


def _unpacked(z) -> pa.Array:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x).decode() for x in z.to_pylist()], pa.large_string())


def _similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    a, b = len(x), len(y)
    if min(a, b) * 100 < max(a, b) * threshold:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (a + b - both)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def verified_links(sets: list[np.ndarray], threshold: int, left: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (places); with left, only of those between the first left and the rest, and among the first."""
    n = len(sets)
    if n == 2:
        return [(0, 1)] if _similar(sets[0], sets[1], threshold) else []
    elements = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    size = np.array([len(s) for s in sets])
    forest, out = _Forest(n), []
    for i in range(n if left is None else left):
        lo, hi = np.searchsorted(elements, sets[i], "left"), np.searchsorted(elements, sets[i], "right")
        count = hi - lo
        places = np.repeat(hi - np.cumsum(count), count) + np.arange(count.sum())
        both = np.bincount(owner[places], minlength=n)
        for j in np.flatnonzero(100 * both >= threshold * (size + size[i] - both)):
            if j > i and forest.join(i, int(j)):
                out.append((i, int(j)))
    return out


LINKS = "a long, b long"


def _blocks_of_rows(batches, key: int):
    """Yields tables of whole runs of equal keys from batches that are sorted by key (a column)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(key)[batch.num_rows - 1].as_py()
        if held and held[-1].column(key)[0].as_py() == last:
            held.append(batch)
            continue
        cut = int(np.searchsorted(batch.column(key).to_numpy(zero_copy_only=False), last))
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verify_runs(threshold: int):
    """Over rows of key, doc_id, z, side, sorted by key: links within each key (side null), or from side 0 to all."""

    @in_worker("hashes")
    def run(batches):
        for table in _blocks_of_rows(batches, 0):
            keys = table.column("key").to_numpy()
            ids = table.column("doc_id").to_numpy()
            sides = table.column("side").to_numpy()
            sets = [s for _, s in sets_of(_unpacked(table.column("z")))]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            out: list[tuple[int, int]] = []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                places = a + np.argsort(sides[a:b], kind="stable")
                left = int((sides[a:b] == 0).sum()) if (sides[a:b] >= 0).any() else None
                found = verified_links([sets[p] for p in places], threshold, left)
                out += [(int(ids[places[i]]), int(ids[places[j]])) for i, j in found]
            yield _link_batch(out)

    return run


def _with_hub(threshold: int):
    """Over rows of doc_id, z, hub, hub_z: doc_id, hub and whether they link."""

    @in_worker("hashes")
    def run(batches):
        for batch in batches:
            out, known = [], {}
            hubs = batch.column(2).to_pylist()
            hub_texts = batch.column(3)
            for (i, s), hub in zip(sets_of(_unpacked(batch.column(1))), hubs):
                if hub not in known:
                    known = {hub: next(x for _, x in sets_of(_unpacked(hub_texts.slice(i, 1))))}
                out.append(_similar(s, known[hub], threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.bool_())], names=["doc_id", "hub", "linked"])

    return run


def _links(documents: DataFrame, candidates: DataFrame, threshold: int) -> DataFrame:
    """Links between the candidates, as a spanning forest of each component."""
    sizes = written(candidates.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("elements")).where("m > 1"), "sizes")
    large = (F.col("m") > TOGETHER) | (F.col("elements") > TOGETHER_ELEMENTS)
    sized = written(join_counted(candidates, sizes, ["comp"], "m").withColumn("large", large), "candidates")
    if sized.count() <= TRAVEL:
        texts = _packed(documents.join(F.broadcast(sized.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(sized), "doc_id")
    else:
        texts = _packed(documents).join(sized.select("doc_id"), "doc_id", "left_semi").join(sized, "doc_id")
    some_large = not sized.where("large").isEmpty()
    if some_large:  # they are read by several steps
        texts = written(texts, "texts")
        release(texts.sparkSession)
    few = texts.where("not large").select(F.col("comp").alias("key"), "doc_id", "z", F.lit(-1).alias("side"))
    few = few.repartition("key").sortWithinPartitions("key").mapInArrow(_verify_runs(threshold), LINKS)
    if not some_large:
        return few
    many = texts.where("large")
    parts = lambda members, elements: F.ceil(F.greatest(members / BLOCK, elements / BLOCK_ELEMENTS)).cast("int")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    many = many.withColumn("cols", parts(F.col("m"), F.col("elements"))).withColumn("c", block("cols"))
    # the smallest member goes to each block of its component
    first = sized.where("large").groupBy("comp").agg(F.min("doc_id").alias("doc_id"))
    hubs = many.join(first.select("doc_id"), "doc_id", "left_semi").select("comp", F.col("doc_id").alias("hub"), F.col("z").alias("hub_z"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    hubs = hubs.dropDuplicates(["comp", "hub", "hub_z", "c"])
    tried = many.join(hubs, ["comp", "c"]).select("doc_id", "z", "hub", "hub_z").mapInArrow(_with_hub(threshold), "doc_id long, hub long, linked boolean")
    tried = written(tried, "hubs")
    release(tried.sparkSession)
    rest = many.join(tried.where("not linked").select("doc_id").distinct(), "doc_id", "left_semi")
    counts = rest.groupBy("comp").agg(parts(F.count("*"), F.sum("n")).alias("rows"), F.first("m").alias("m"), (F.first("elements") * (F.first("cols") + F.col("rows"))).alias("moved"))
    counts = written(counts, "rest")
    turns = math.ceil((counts.agg(F.sum("moved")).first()[0] or 0) / (MOVED * sizes.agg(F.sum("elements")).first()[0]))
    again = rest.select("doc_id").distinct().withColumn("again", F.lit(True))
    blocks = join_counted(many.drop("m"), counts.drop("moved"), ["comp"], "m").join(again, "doc_id", "left")
    blocks = written(blocks.select("comp", "doc_id", "z", "rows", "cols", "c", F.coalesce("again", F.lit(False)).alias("again")), "blocks")
    release(blocks.sparkSession)
    right = blocks.select("comp", "doc_id", "z", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), "c")
    left = blocks.where("again").select("comp", "doc_id", "z", F.lit(0).alias("side"), block("rows").alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    pairs = right.unionByName(left).select(F.xxhash64("comp", "r", "c").alias("key"), "doc_id", "z", "side")
    out = few.unionByName(tried.where("linked and doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    for turn in range(turns):
        own = pairs.where(F.pmod("key", F.lit(turns)) == turn).repartition("key").sortWithinPartitions("key").mapInArrow(_verify_runs(threshold), LINKS)
        out = out.unionByName(written(own.where("a <> b"), "links"))
        release(blocks.sparkSession)
    discard(blocks)
    return out


def jaccard_components(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id.

    Two documents link when 100 * |x & y| >= threshold * |x | y| of their
    shingle sets; component_id is the smallest doc_id that links lead to, the
    document's own included. A text without words, or null, links with nothing.
    Rows that share a doc_id count as one document when links are followed, so
    that all of them get the smallest id that any of them reaches. A row with a
    null doc_id has a null component_id and is not compared. An empty table
    gives an empty one; other columns are ignored.
    """
    sets = written(shingle_sets(documents, threshold), "sets")
    some = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    same = some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    same = written(same.where("copies > 1"), "copies")
    equal = join_counted(some.select("n", "s1", "s2", "doc_id"), same, ["n", "s1", "s2"], "copies").where(F.col("doc_id") > F.col("first")).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    equal = written(equal, "equal")
    candidates = written(_candidates(some, threshold), "compared")
    sizes = written(sets.select("doc_id", F.col("n").alias("n_shingles")), "n_shingles")
    discard(sets, same)  # the prefixes have done their work, and are the largest table
    release(documents.sparkSession)
    found = components(_links(documents.where(F.col("doc_id").isNotNull()), candidates, threshold).unionByName(equal))
    return sizes.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import table

    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS e FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.e = y.e AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), u AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT a AS node, b AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS low FROM r GROUP BY node) m USING (doc_id)
"""
