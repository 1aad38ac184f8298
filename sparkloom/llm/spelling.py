"""Spelling variants: words one edit apart, found by a variable-length gram index.

1. Words are counted in tasks that hand on a bounded table of counts at a time.
2. The gram dictionary: grams of QMIN to QMAX - 1 characters that occur in more
   words than a share of all grams are frequent; a bounded number, the only thing
   besides a fixed number of counters that goes to the driver. A word, with marks
   at both ends, has at each place one gram: the shortest of at least QMIN
   characters that isn't frequent, or QMAX, or what is left of the word. Which
   gram that is, its own characters say, so that an edit changes no gram that it
   doesn't touch. (Grams that lie inside their neighbours stay, as whether they
   do depends on neighbours that an edit may touch.)
3. The most grams of a word that one edit can touch is its bound: with g grams,
   any near word has at least g - bound of them. So both have one of their
   bound + 1 rarest grams in common, and only these enter the lists.
4. A gram before the edit has everything before it in common as well, one behind
   the edit everything behind it: a list is kept for a gram and that remainder.
   Lists are merged, and pairs verified, in tasks over sorted lists of at most
   LIST words. The words of longer lists are dealt again by the words that remain
   if one character is deleted, which near words share, too.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import HEAVY, discard, in_worker, written

QMIN, QMAX = 2, 4
#: A gram is frequent if more than one in so many grams is that gram, and more than so many are.
FREQUENT_SHARE, FREQUENT_LEAST = 1 << 15, 32
#: Counters that grams are hashed to, to tell rare from common ones.
COUNTERS = 1 << 16
#: Words of a list that are compared with each other.
LIST = 512
#: Distinct words that a task counts before it hands them on, and pairs that it looks at at a time.
COUNTED, AT_ONCE = 200_000, 1 << 20
#: Characters up to which words are compared as rows of a matrix.
WIDE = 48
#: One in so many occurrences loses a character in the query's contract, and words must have so many characters and occurrences.
MISSPELT, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
ROUNDS = 40

#: What each byte of Latin-1 counts as: letters (of À-ÿ all) as themselves, A-Z in lower case, all others as a gap.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def _runs(doc_id, text: str, misspelt: int | None) -> dict[bytes, int]:
    """document_words() as Latin-1, which has a byte for each character that a run can have; others become gaps."""
    counts = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
    if not misspelt:
        return counts
    head, shorter = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), []
    for run in counts:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
        if h % misspelt == 0:
            shorter.append((run, h % len(run)))
    cut = [(run[:at] + run[at + 1 :], counts.pop(run)) for run, at in shorter]
    for run, n in cut:
        counts[run] += n
    return counts


def document_words(doc_id, text: str, misspelt: int | None = MISSPELT) -> dict[str, int]:
    """The lower-cased runs of a text with their counts; of a run whose hash with the document's id misspelt divides, a character is gone."""
    return {run.decode("latin-1"): n for run, n in _runs(doc_id, text, misspelt).items()}


def count_words(documents: DataFrame, misspelt: int | None = MISSPELT, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n over all rows of doc_id and text. Null texts have no words, a null id counts as an empty one, repeated rows count again."""

    def count(batches):
        held: dict[bytes, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    for word, n in _runs(doc_id, text.as_py(), misspelt).items():
                        if len(word) >= least_length:
                            held[word] = held.get(word, 0) + n
                    if len(held) > COUNTED:
                        yield flush()
        if held:
            yield flush()

    counted = documents.select("doc_id", "text").mapInArrow(in_worker("spelling")(count), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def marked(word: str) -> str:
    return f"\1{word}\2"


def frequent_grams(words: DataFrame, share: int = FREQUENT_SHARE, least: int = FREQUENT_LEAST) -> frozenset[str]:
    """Grams of QMIN to QMAX - 1 characters that more than one in share of all grams are: fewer than share for each length."""
    marks = F.concat(F.lit("\1"), "word", F.lit("\2"))
    size = F.sum(F.length("word") + 2).alias("n")
    total = words.agg(size).first()[0] or 0
    found: list[str] = []
    for q in range(QMIN, QMAX):
        grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 3 - q), lambda i: F.substring(marks, i, F.lit(q)))).alias("gram"))  # noqa: B023
        found += [r["gram"] for r in grams.groupBy("gram").count().where(F.col("count") > max(least, total // share)).select("gram").collect()]
    return frozenset(found)


def decompose(text: str, frequent: frozenset[str]) -> list[int]:
    """Where the gram at each place of a marked word ends."""
    n, ends = len(text), []
    for at in range(n - 1):
        end = at + QMIN
        while end < n and end - at < QMAX and text[at:end] in frequent:
            end += 1
        ends.append(end)
    return ends


def affected(ends: list[int]) -> int:
    """The most grams that cover one character, marks aside: what one edit can touch."""
    most = 0
    for at in range(1, len(ends)):
        most = max(most, sum(end > at for end in ends[max(0, at - QMAX + 1) : at + 1]))
    return most


def _counter(gram: str) -> int:
    return zlib.crc32(gram.encode()) % COUNTERS


def gram_counters(words: DataFrame, frequent: frozenset[str]) -> np.ndarray:
    """How many of all words' grams fall on each of COUNTERS counters."""

    def count(batches):
        sums = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                text = marked(word)
                for at, end in enumerate(decompose(text, frequent)):
                    sums[_counter(text[at:end])] += 1
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(sums[there])], names=["counter", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for r in words.select("word").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        out[r["counter"]] = r["n"]
    return out


def list_keys(word: str, frequent: frozenset[str], counters: np.ndarray) -> list[int]:
    """The lists that a word is in: for its bound + 1 rarest grams the list of all before, and that of all behind."""
    text = marked(word)
    ends = decompose(text, frequent)
    order = sorted((int(counters[_counter(gram)]), gram, at) for at, end in enumerate(ends) for gram in (text[at:end],))
    keys = set()
    for _, _, at in order[: affected(ends) + 1]:
        keys.add(xxhash.xxh3_64_intdigest(text[: ends[at]].encode(), 1))
        keys.add(xxhash.xxh3_64_intdigest(text[at:].encode(), 2))
    return sorted(keys)


def deletion_keys(word: str, key: int) -> list[int]:
    """For words of a long list: the word itself, and without each of its characters."""
    found = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    return sorted(xxhash.xxh3_64_intdigest(x.encode(), (key + 3) & (2**64 - 1)) for x in found)


LISTED = "key long, word string, n long"


def _listed(keys_of, many: bool):
    def run(batches):
        for batch in batches:
            keys, place = [], []
            had = batch.column(2).to_pylist() if many else [None] * len(batch)
            for i, (word, key) in enumerate(zip(batch.column(0).to_pylist(), had)):
                own = keys_of(word, key)
                keys += own
                place += [i] * len(own)
            rows = batch.take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), rows.column(0), rows.column(1)], names=["key", "word", "n"])

    return run


def near(a: str, b: str) -> bool:
    """Exactly one character inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def near_places(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of places i, j hold near words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(i), bool)
    left = np.flatnonzero(np.abs(sizes[i] - sizes[j]) <= 1)
    if not len(left):
        return out
    wide = np.minimum(sizes, WIDE)
    cps = np.frombuffer("".join(w[:WIDE] for w in words).encode("utf-32-le"), np.uint32)
    start = np.cumsum(wide) - wide
    row = np.repeat(np.arange(len(words)), wide)
    seen = np.zeros(len(words), np.uint64)  # characters of a word, hashed to bits: an edit takes one away and adds one at most
    np.bitwise_or.at(seen, row, np.uint64(1) << ((cps * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint64))
    left = left[np.bitwise_count(seen[i[left]] ^ seen[j[left]]) <= 2]
    long = (sizes[i[left]] > WIDE) | (sizes[j[left]] > WIDE)
    for p in left[long]:
        out[p] = near(words[i[p]], words[j[p]])
    left = left[~long]
    width = int(wide.max()) + 1
    matrix = np.zeros((len(words), width), np.uint32)
    matrix[row, np.arange(len(cps)) - start[row]] = cps
    swap = sizes[i[left]] > sizes[j[left]]
    a, b = np.where(swap, j[left], i[left]), np.where(swap, i[left], j[left])
    same = matrix[a] == matrix[b]
    ahead = np.argmin(same, axis=1)  # of the first place that differs
    ahead = np.where(same.all(axis=1), width, ahead)
    shifted = matrix[a, :-1] == matrix[b, 1:]
    at = np.arange(width - 1)
    equal = sizes[a] == sizes[b]
    behind_same = (same[:, 1:] | (at < ahead[:, None])).all(axis=1)
    behind_shifted = (shifted | (at < ahead[:, None])).all(axis=1)
    out[left] = np.where(equal, behind_same & (ahead < width), behind_shifted)
    return out


NEAR = "a string, b string, n_a long, n_b long"


def _merged(batches):
    """Near pairs of rows that come sorted by key, each pair of a list once; a list may go on in the next batch."""
    rest = None
    for batch in _with_end(batches):
        if batch is None:
            table, last = rest, True
        else:
            table, last = (pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])), False
        if table is None or not len(table):
            continue
        keys = table.column(0).to_numpy()
        whole = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
        rest = None if last else table.slice(whole)
        if whole:
            yield from _pairs_of(table.slice(0, whole))


def _with_end(batches):
    yield from batches
    yield None


def _pairs_of(table: pa.Table):
    keys, words, counts = table.column(0).to_numpy(), table.column(1).to_pylist(), table.column(2).to_numpy()
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    ahead = np.repeat(start + size, size) - np.arange(len(keys)) - 1  # rows of the list behind a row
    upto = np.cumsum(ahead)
    low = 0
    while low < len(keys):
        base = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, base + AT_ONCE, "right")))
        own = ahead[low:high]
        i = np.repeat(np.arange(low, high), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        if len(i):
            first, last = low, int(j.max()) + 1
            hit = near_places(words[first:last], i - first, j - first)
            x, y = i[hit], j[hit]
            swap = np.array([words[p] > words[q] for p, q in zip(x, y)], bool)
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield pa.RecordBatch.from_arrays([pa.array([words[p] for p in x], pa.string()), pa.array([words[p] for p in y], pa.string()), pa.array(counts[x]), pa.array(counts[y])], names=["a", "b", "n_a", "n_b"])
        low = high


def _compare(lists: DataFrame) -> DataFrame:
    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(in_worker("spelling")(_merged), NEAR)


def near_words(words: DataFrame, share: int = FREQUENT_SHARE, longest: int = LIST) -> DataFrame:
    """Pairs of near words (a < b, n_a, n_b), each once, of distinct words with n."""
    frequent = frequent_grams(words, share)
    counters = gram_counters(words, frequent)
    listed = written(words.select("word", "n").mapInArrow(in_worker("spelling")(_listed(lambda w, _: list_keys(w, frequent, counters), False)), LISTED), "lists")
    long = written(listed.groupBy("key").count().where(F.col("count") > longest).select("key"), "long")
    n_long = long.count()
    if n_long:
        some = F.broadcast(long) if n_long <= HEAVY else long
        again = listed.join(some, "key", "left_semi").select("word", "n", "key").mapInArrow(in_worker("spelling")(_listed(deletion_keys, True)), LISTED)
        found = _compare(listed.join(some, "key", "left_anti")).unionByName(_compare(again))
    else:
        found = _compare(listed)
    out = written(found.distinct(), "near")
    discard(listed, long)
    return out


def variants(words: DataFrame, share: int = FREQUENT_SHARE, longest: int = LIST) -> DataFrame:
    """word, n, n_near, form, form_n and root of distinct words with n.

    form is the near word of largest n, the smallest of several, if it has at
    least twice the word's n; root is where forms lead. Words that are near to
    none have n_near 0, no form and themselves as root; no rows give no rows.
    """
    pairs = near_words(words, share, longest)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    rows = words.select("word", "n").join(best, "word", "left")
    has = -F.col("best.m") >= 2 * F.col("n")
    formed = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")), "forms")
    # a chain doubles n with each form, so that it is short: each round halves what is left of it
    way = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = written(way.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discard(way)
        way = longer.drop("moved")
        way._written_at = longer._written_at
        if longer.where("moved").isEmpty():
            return formed.join(way, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
    raise RuntimeError("forms lead nowhere")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import table

    words = written(count_words(table(spark, sf_dir, "documents", "doc_id", "text")), "words")
    return variants(words)


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS steps FROM range(256) AS u(i)
), g AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) GROUP BY ALL
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))),
         lambda x, b: xor(x >> 8, steps[xor(x & 255, b) + 1])), 4294967295) AS h FROM g, t
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), v AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM v a JOIN w b ON a.rest = b.word
), f AS (
  SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.m >= 2 * w.n THEN x.other END AS form, CASE WHEN x.m >= 2 * w.n THEN x.m END AS form_n
  FROM w LEFT JOIN (SELECT word, count(*) AS n_near, max(m) AS m, first(other ORDER BY m DESC, other) AS other FROM p GROUP BY word) x USING (word)
), r AS (
  SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.at AS root FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.at AND e.form IS NULL
"""
