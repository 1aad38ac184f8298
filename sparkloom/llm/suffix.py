"""Removal of repeated strings by blockwise suffix sorting with a difference cover.

1. Candidates. Of each window of SPAN bytes the smallest hash among its substrings
   of gram bytes (the leftmost of equal ones) is its anchor; equal windows have
   equal anchors at equal places. The windows of one anchor cover one stretch of
   a text, its context. Contexts are counted by two 64-bit hashes: what occurs
   twice as a whole is repeated as a whole and need not be sorted, and an anchor
   with one context has no repeats.
2. Suffix buckets. What is left, one of each context, is brought together by
   anchor, which is a string that all suffixes of the bucket share. A bucket of
   more than TOGETHER contexts is split by a longer common string: its contexts
   are cut anew with gram halfway nearer to SPAN. At gram = SPAN each window is
   a context, and counting settles all, so that no bucket grows with its copies.
3. Blocks. A task sorts the suffixes of one block of buckets at a time. First the
   suffixes at the places of a difference cover modulo v are ranked (by v bytes,
   then by doubling). Suffixes are ordered by their first v bytes, and ties by the
   ranks at the distance, below v, at which both have a place of the cover.
   Neighbours in that order that agree over SPAN bytes are repeated.

A cover of the whole corpus would mean to move each of its samples with v bytes
on both sides, many times the text; so it is laid over blocks of candidates.
Texts move twice, compressed: to be cut at anchors, and to lose what is repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import in_worker, join_counted, written
from .jaccard import _blocks_of_rows, _mix, _powers

#: Bytes of a repeated string, bytes of the first anchors, and the root of the cover's modulus (a multiple of 4).
SPAN, GRAM, ROOT = 200, 48, 4
#: Contexts of a bucket that is not split any more, and bytes of contexts that are sorted at a time, a bucket at least.
TOGETHER, BLOCK = 4_000, 1 << 20
#: Windows of a text that are looked at together; longer texts are cut into such pieces.
SLICE = 1 << 20
PLACE = np.uint64((1 << 22) - 1)


def anchors(data: np.ndarray, ends: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, context's hash, piece, first, last): each anchor of the pieces in data, and the first and last window that it is the anchor of.

    ends are the pieces' ends in data; places are counted from a piece's begin.
    """
    n, w = len(data), span - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < span:
        return none
    power, inverse = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    h = _mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    m = len(h)
    value = (h & ~PLACE) | np.arange(m, dtype=np.uint64)
    padded = np.full(-(-m // w) * w + w, ~np.uint64(0))
    padded[:m] = value
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - span + 1
    chosen = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & PLACE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    piece = np.repeat(np.arange(len(ends)), ends - starts)[:windows]
    valid = np.flatnonzero(np.arange(windows) + span <= ends[piece])
    if not len(valid):
        return none
    chosen, piece = chosen[valid], piece[valid]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(valid)]]) - 1
    owner, a, b = piece[first], valid[first], valid[last]
    context = _mix((sums[b + span] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    return h[chosen[first]], context, owner, a - starts[owner], b - starts[owner]


def _keyed(documents: DataFrame) -> DataFrame:
    """k and t tell rows apart by id and text; rows that share both are the same text and get the same answer."""
    text_key = F.xxhash64("text", F.col("doc_id").isNull())
    return documents.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("k"), text_key.alias("t"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


ANCHORS = "h long, c long, k long, t long, first int, last int"


def _anchor_rows(documents: DataFrame, span: int, gram: int) -> DataFrame:
    def pieces(texts):
        """(row, place, bytes) of pieces of at most SLICE windows, in lists of about SLICE bytes."""
        held, size = [], 0
        for row, text in enumerate(texts):
            data = text.as_py().encode()
            for place in range(0, max(1, len(data) - span + 1), SLICE):
                held.append((row, place, data[place : place + SLICE + span - 1]))
                size += len(held[-1][2])
                if size >= SLICE:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    @in_worker("hashes")
    def run(batches):
        for batch in batches:
            k, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for some in pieces(batch.column(2)):
                row, place = np.array([p[0] for p in some]), np.array([p[1] for p in some])
                h, c, own, first, last = anchors(np.frombuffer(b"".join(p[2] for p in some), np.uint8), np.cumsum([len(p[2]) for p in some]), span, gram)
                columns = [h.view(np.int64), c.view(np.int64), k[row[own]], t[row[own]], (first + place[own]).astype(np.int32), (last + place[own]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_names(ANCHORS))

    return _keyed(documents).select("k", "t", "text").mapInArrow(run, ANCHORS)


def _packed(documents: DataFrame) -> DataFrame:
    """k, t, doc_id, z: texts compressed, for the shuffles."""

    @in_worker("hashes")
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = pa.array([pack(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], names=["k", "t", "doc_id", "z"])

    return _keyed(documents).mapInArrow(run, "k long, t long, doc_id long, z binary")


CONTEXTS = "h long, m long, k long, t long, first int, last int, bytes binary"


def _contexts(joined: DataFrame, span: int) -> DataFrame:
    """The bytes that an anchor's windows cover, for rows of k, t, z, at (a list of h, m, first, last)."""

    @in_worker("hashes")
    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            k, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            fields = {f: lists.flatten().field(f).to_numpy() for f in ("h", "m", "first", "last")}
            cut = np.asarray(lists.offsets.to_numpy()) - lists.offsets[0].as_py()
            for i, z in enumerate(batch.column(2)):
                data = unpack(z.as_py())
                a, b = cut[i], cut[i + 1]
                first, last = fields["first"][a:b], fields["last"][a:b]
                parts = [data[x : y + span] for x, y in zip(first, last)]
                columns = [fields["h"][a:b], fields["m"][a:b], np.full(b - a, k[i]), np.full(b - a, t[i]), first, last]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary())], names=_names(CONTEXTS))

    return joined.select("k", "t", "z", "at").mapInArrow(run, CONTEXTS)


CUT = "h long, c long, k long, t long, first int, last int, bytes binary"


def _cut_anew(contexts: DataFrame, span: int, gram: int) -> DataFrame:
    """Contexts cut at anchors of another length; the bytes go with them."""

    @in_worker("hashes")
    def run(batches):
        for batch in batches:
            k, t, begin = (batch.column(i).to_numpy() for i in range(3))
            parts = batch.column(3).to_pylist()
            h, c, own, first, last = anchors(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), span, gram)
            cut = pa.array([parts[o][a : b + span] for o, a, b in zip(own, first, last)], pa.binary())
            columns = [h.view(np.int64), c.view(np.int64), k[own], t[own], (first + begin[own]).astype(np.int32), (last + begin[own]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), cut], names=_names(CUT))

    return contexts.select("k", "t", "first", "bytes").mapInArrow(run, CUT)


def difference_cover(root: int) -> tuple[np.ndarray, np.ndarray]:
    """Which residues modulo root * root are in the cover, and for each two residues the smallest distance at which both reach it."""
    v = root * root
    inside = np.zeros(v, bool)
    inside[:root] = inside[::root] = True
    after = np.array([np.roll(inside, -d) for d in range(v)])  # by distance and residue
    return inside, (after[:, :, None] & after[:, None, :]).argmax(axis=0)


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1 by the keys, the first the weightiest; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return rank


def suffix_order(data: np.ndarray, at: np.ndarray, span: int, root: int = ROOT) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data that begin at the places at, in order, and whether each agrees with the one before over span bytes; span is a multiple of 8."""
    v, n = root * root, len(data)
    inside, distance = difference_cover(root)
    padded = np.concatenate([data, np.zeros(span + v + 8, np.uint8)]).astype(np.uint64)
    word = padded[: n + span + v].copy()
    for i in range(1, 8):
        word = (word << np.uint64(8)) | padded[i : i + n + span + v]
    leading = range(0, v, 8)
    # ranks of the cover's samples: by v bytes, then by twice as many until no two are equal
    sample = np.flatnonzero(inside[np.arange(n) % v])
    rank = np.zeros(n + span + v, np.int64)
    rank[sample] = _ranked([word[sample + i] for i in leading])
    depth = v
    while depth < n and rank.max() < len(sample):
        beyond = np.where(sample + depth < n, rank[np.minimum(sample + depth, n)], 0)
        rank[sample] = _ranked([rank[sample] * np.int64(n + 2) + beyond])
        depth *= 2
    # all suffixes by v bytes
    order = np.lexsort([word[at + i] for i in reversed(leading)])
    at = at[order]
    new = np.ones(len(at), bool)
    new[1:] = False
    for i in leading:
        own = word[at + i]
        new[1:] |= own[1:] != own[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    # ties by merging runs, in which each suffix finds its place among the other run's by bisection
    begin, size = np.repeat(begin, size), np.repeat(size, size)
    run = 1
    residue = at % v
    while len(active := np.flatnonzero(size > run)):
        start, full, x, rx = begin[active], size[active], at[active], residue[active]
        local = active - start
        own = local // run
        other = (own ^ 1) * run
        low, high = other.copy(), np.minimum(other + run, full)
        right = (own & 1).astype(bool)
        for _ in range(run.bit_length()):
            middle = np.minimum((low + high) >> 1, full - 1)
            y = at[start + middle]
            d = distance[rx, y % v]
            a, b = rank[y + d], rank[x + d]
            before = (low < high) & ((a < b) | (right & (a == b)))
            high = np.where((low < high) & ~before, middle, high)
            low = np.where(before, middle + 1, low)
        place = start + (own >> 1) * (2 * run) + (local - own * run) + np.where(other < full, low - other, 0)
        at[place], residue[place] = x, rx
        run *= 2
    alike = np.flatnonzero(~new)
    for i in range(v, span, 8):
        alike = alike[word[at[alike] + i] == word[at[alike - 1] + i]]
    same = np.zeros(len(at), bool)
    same[alike] = True
    return at, same


def repeated_windows(parts: list[bytes], count: np.ndarray, span: int, root: int = ROOT) -> np.ndarray:
    """Marks the windows, count[i] from the begin of parts[i] on, of which there is an equal one; all in one array.

    A number follows each part, so that suffixes differ soon after its end.
    """
    lengths = count + span - 1 + 8
    offset = np.cumsum(lengths) - lengths
    upto = np.cumsum(count)
    at = np.repeat(offset - (upto - count), count) + np.arange(upto[-1])
    data = np.frombuffer(b"".join([p + i.to_bytes(8, "big") for i, p in enumerate(parts)]), np.uint8)
    ordered, same = suffix_order(data, at, span, root)
    marks = np.zeros(len(data), bool)
    marks[ordered[same]] = True
    marks[ordered[np.flatnonzero(same) - 1]] = True
    return marks[at]


SPANS = "k long, t long, start int, stop int"


def _sort_blocks(span: int, root: int, block: int):
    """Over rows of CONTEXTS, sorted by h: the repeated spans of each bucket."""

    @in_worker("hashes")
    def run(batches):
        for table in _blocks_of_rows(batches, 0):
            h, k, t, first, last = (table.column(i).to_numpy() for i in (0, 2, 3, 4, 5))
            parts = table.column(6).to_pylist()
            size = np.cumsum([len(p) for p in parts])
            bucket = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            a = 0
            while a < len(h):
                fit = int(np.searchsorted(size, (size[a - 1] if a else 0) + block, "right"))
                ends = bucket[(bucket > a) & (bucket <= max(fit, a + 1))]
                b = int(ends[-1] if len(ends) else bucket[bucket > a][0])
                count = (last[a:b] - first[a:b] + 1).astype(np.int64)
                marks = repeated_windows(parts[a:b], count, span, root)
                upto = np.cumsum(count)
                edge = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
                # runs of marks end where a context does
                cut = np.zeros(len(marks) + 1, bool)
                cut[upto] = True
                inner = np.flatnonzero(cut[:-1] & np.concatenate([[False], marks[:-1]]) & marks)
                x = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
                y = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
                row = np.searchsorted(upto, x, "right")
                move = first[a:b][row] - (upto[row] - count[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[a:b][row]), pa.array(t[a:b][row]), pa.array((x + move).astype(np.int32)), pa.array((y - 1 + move + span).astype(np.int32))], names=_names(SPANS)
                )
                a = b

    return run


def repeated_spans(documents: DataFrame, span: int = SPAN, gram: int = GRAM, root: int = ROOT, together: int = TOGETHER, block: int = BLOCK) -> DataFrame:
    """k, t, start, stop: byte ranges, overlapping ones too, that strings of span bytes with another occurrence cover."""
    rows = written(_anchor_rows(documents, span, gram), "anchors")
    parts = []
    while True:
        # one of each context, and how many there are; of each anchor, how many contexts
        one = F.min(F.struct(*(c for c in rows.columns if c not in "hc"))).alias("one")
        kinds = written(rows.groupBy("h", "c").agg(F.count("*").alias("n"), one), "kinds")
        buckets = written(kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
        again = join_counted(rows.select("h", "c", "k", "t", "first", "last"), kinds.where("n > 1").select("h", "c", "n"), ["h", "c"], "n")
        parts.append(again.select("k", "t", F.col("first").alias("start"), (F.col("last") + span).alias("stop")))
        shared = join_counted(kinds.select("h", "one.*"), buckets, ["h"], "m")
        if "bytes" not in shared.columns:
            lists = shared.groupBy("k", "t").agg(F.collect_list(F.struct("h", "m", "first", "last")).alias("at"))
            shared = _contexts(_packed(documents).join(lists, ["k", "t"]), span)
        shared = written(shared, "contexts")
        few = shared.where(F.col("m") <= together).select(*_names(CONTEXTS))
        parts.append(few.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_blocks(span, root, block), SPANS))
        large = shared.where(F.col("m") > together)
        if gram == span or large.isEmpty():
            break
        gram += (span - gram + 1) // 2
        rows = written(_cut_anew(large, span, gram), "anchors")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(documents: DataFrame, keep_text: bool = True, **settings) -> DataFrame:
    """One row per row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and, if keep_text, kept (binary).

    Each byte goes that lies in a string of span bytes which also starts
    elsewhere, in the same text or in another; all of its copies go. What is
    kept may begin or end within a character. Null texts are empty; texts
    shorter than span stay as they are; a row that repeats another loses all
    that spans cover; texts may be longer than any piece that is looked at; null doc_ids stay null, other columns are ignored, and an
    empty table gives an empty one.
    """
    spans = repeated_spans(documents, **settings).groupBy("k", "t").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = _packed(documents).join(spans, ["k", "t"], "left").select("doc_id", "z", F.array_sort("spans").alias("spans"))
    schema = KEPT + (", kept binary" if keep_text else "")

    @in_worker("hashes")
    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for z, spans in zip(batch.column(1), batch.column(2)):
                data, upto, removed, runs, parts = unpack(z.as_py()), 0, 0, 0, []
                for s in spans.as_py() or ():
                    a, b = s["start"], s["stop"]
                    if not runs or a > upto:
                        runs += 1
                        parts.append(data[upto:a])
                        removed += b - a
                        upto = b
                    elif b > upto:
                        removed += b - upto
                        upto = b
                parts.append(data[upto:])
                kept = b"".join(parts)
                out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest()) + ((kept,) if keep_text else ()))
            types = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * keep_text
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, p) for c, p in zip(columns, types))], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import table

    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)
