"""Benchmark decontamination by winnowing, in SQL functions only.

Words are hashed, k-grams of words are hashed from those, and of each window of
WINDOW words the smallest k-gram hash (the leftmost of equal ones) is its
fingerprint. Neighbouring windows mostly share theirs: a text keeps one
fingerprint, with its place, for each such run of windows. Equal windows have
equal fingerprints at equal places, so no shared span of WINDOW words or more can
be missed.

Fingerprints of the benchmark set bits in a map, sized by their number, which
travels as a literal. Those of documents whose bit is not set are dropped where
they are made; the others are joined with the benchmark's by fingerprint alone.
Each hit is then extended word by word to both sides, and counts if it reaches
the length of a window. The benchmark's side is broadcast only if it is counted
to be small; a large benchmark is joined by a shuffle: slower, but the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, written

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
WINDOW, GRAM = 10, 5
#: Bits of the map for each fingerprint of the benchmark, and in all at least and at most (512 kB).
BITS_EACH, BITS_LEAST, BITS_MOST = 64, 1 << 14, 1 << 22
#: The benchmark's side is broadcast up to so many fingerprints and references to items (some 30 MB).
SMALL = 100_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def _grams(hashes: Column, k: int) -> Column:
    """The hash of the k words from each place on; the last k - 1 are of no use."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, *(F.get(hashes, i + n) for n in range(1, k))))


def _minima(grams: Column, w: int) -> Column:
    """The smallest of w neighbours, from each place on; the last w - 1 are of no use."""
    return F.transform(grams, lambda x, i: F.least(x, *(F.get(grams, i + n) for n in range(1, w)))) if w > 1 else grams


def _sizes(size: int) -> tuple[int, int]:
    """k and the number of k-grams of a window of so many words."""
    k = min(GRAM, size)
    return k, size - k + 1


def _runs(n: Column, grams: Column, minima: Column, size: int, keep=None) -> Column:
    """(fingerprint, size, q) of each run of windows with one fingerprint, which is the gram at place q; of windows that keep allows only."""
    w = _sizes(size)[1]
    places = F.sequence(F.lit(0), n - size)
    if keep is not None:
        places = F.filter(places, lambda i: keep(F.get(minima, i)))
    at = lambda i: (i + F.array_position(F.slice(grams, i + 1, w), F.get(minima, i)) - 1).cast("int")
    runs = F.transform(places, lambda i: F.struct(F.get(minima, i).alias("fingerprint"), F.lit(size).alias("size"), (at(i) if w > 1 else i).alias("q")))
    return F.when(n >= size, F.array_distinct(runs))


def _around(words: Column, run: Column, width: Column) -> tuple[Column, Column]:
    """The words that the run's windows cover: those before the gram, from there to the left, and those from the gram on."""
    q = run["q"]
    before = F.least(q, width - 1)
    return F.reverse(F.slice(words, q - before + 1, before)), F.slice(words, q + 1, run["size"])


def _width(size: Column) -> Column:
    """The number of grams of a window of size words."""
    return size - F.least(size, F.lit(GRAM)) + 1


def benchmark_fingerprints(benchmark: DataFrame) -> DataFrame:
    """fingerprint, size, before, after, items: each distinct run of windows, with the words around, and the ids (as strings) of the items that have it.

    An item of fewer than WINDOW words, but not none, is one window.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    items = items.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n", F.size("w"))
    sizes = range(1, WINDOW + 1)
    items = items.select("*", *(_grams(F.col("h"), k).alias(f"g{k}") for k in {_sizes(s)[0] for s in sizes}))
    items = items.select("*", *(_minima(F.col(f"g{_sizes(s)[0]}"), _sizes(s)[1]).alias(f"m{s}") for s in sizes))
    runs = F.lit(None)
    for s in sizes:
        own = F.col("n") >= s if s == WINDOW else F.col("n") == s
        runs = F.when(own, _runs(F.col("n"), F.col(f"g{_sizes(s)[0]}"), F.col(f"m{s}"), s)).otherwise(runs)
    rows = items.select("item", "w", F.explode(runs).alias("run"))
    before, after = _around(F.col("w"), F.col("run"), _width(F.col("run.size")))
    rows = rows.select("item", "run.fingerprint", "run.size", before.alias("before"), after.alias("after"))
    return rows.groupBy("fingerprint", "size", "before", "after").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _bit_map(prints: DataFrame, bits: int) -> Column:
    """The map as a literal: at most bits / 64 rows come here."""
    place = F.pmod("fingerprint", F.lit(bits))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")))
    rows = prints.groupBy(F.shiftright(place, 6).alias("at")).agg(word.alias("word")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["at"]] = r["word"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _alike(x: Column, y: Column) -> Column:
    """How many elements from the first on are equal."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
    return F.when(differs == 0, F.size(x)).otherwise(differs - 1)


def contamination(documents: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """One row per row of documents: the columns keep, n_words, n_hit, n_items, items (sorted ids), contaminated.

    n_hit counts the words that lie inside any occurrence of any window, n_items
    the distinct items such windows belong to. Null and empty texts have no words
    and hits; null doc_ids stay null; repeated rows give repeated rows; an empty
    benchmark hits nothing; items that share an id count once, a null id is the
    empty string; other columns are ignored.
    """
    prints = written(benchmark_fingerprints(benchmark), "fingerprints")
    known = prints.agg(F.collect_set("size"), F.count("*"), F.sum(F.size("items") + 1)).first()
    sizes, count, total = sorted(known[0]), known[1], known[2] or 0
    n_bits = min(max(1 << (BITS_EACH * count).bit_length(), BITS_LEAST), BITS_MOST)
    bits = _bit_map(prints, n_bits)
    docs = documents.select(F.monotonically_increasing_id().alias("_row"), *(F.col(c).alias(f"_keep_{c}") for c in keep), words_of(F.col("text")).alias("_words"))
    kept = ["_row", *(f"_keep_{c}" for c in keep)]
    docs = docs.withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))
    grams = {k: f"_grams_{k}" for k in {_sizes(s)[0] for s in sizes}}
    docs = docs.select("*", *(_grams(F.col("_hashes"), k).alias(name) for k, name in grams.items()))
    minima = {s: f"_minima_{s}" for s in sizes}
    docs = docs.select("*", *(_minima(F.col(grams[_sizes(s)[0]]), _sizes(s)[1]).alias(name) for s, name in minima.items()))

    def is_set(fingerprint: Column) -> Column:
        place = F.pmod(fingerprint, F.lit(n_bits))
        word = F.get(bits, F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    empty = F.from_json(F.lit("[]"), "array<struct<fingerprint:bigint,size:int,q:int>>")
    runs = (F.coalesce(_runs(F.size("_words"), F.col(grams[_sizes(s)[0]]), F.col(minima[s]), s, is_set), empty) for s in sizes)
    docs = docs.select(*kept, "_words", F.concat(*runs).alias("_runs") if sizes else empty.alias("_runs"))

    def cut(run: Column) -> Column:
        before, after = _around(F.col("_words"), run, _width(run["size"]))
        return F.struct(run["fingerprint"].alias("fingerprint"), run["size"].alias("size"), run["q"].alias("q"), before.alias("own_before"), after.alias("own_after"))

    flat = docs.select(*kept, F.size("_words").cast("long").alias("n_words"), F.transform("_runs", cut).alias("_found"))
    flat = flat.select(*kept, "n_words", F.explode_outer("_found").alias("_c")).select(*kept, "n_words", "_c.*")
    side = F.broadcast(prints) if total <= SMALL else prints
    hits = flat.join(side, ["fingerprint", "size"], "left")
    hits = hits.select(*kept, "n_words", "size", "q", "items", _alike(F.col("own_before"), F.col("before")).alias("_left"), _alike(F.col("own_after"), F.col("after")).alias("_right"))
    long_enough = F.col("_left") + F.col("_right") >= F.col("size")
    hits = hits.select(*kept, "n_words", F.when(long_enough, F.col("items")).alias("items"), F.when(long_enough, F.struct((F.col("q") - F.col("_left")).alias("at"), (F.col("q") + F.col("_right") - 1).alias("upto"))).alias("_hit"))
    out = hits.groupBy(*kept, "n_words").agg(F.collect_set("_hit").alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["at"], h["upto"]))))
    out = out.withColumn("n_hit", F.size(covered).cast("long"))
    return out.select(*(F.col(f"_keep_{c}").alias(c) for c in keep), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    out = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), "doc_id")
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), s AS (
  SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM s
), p AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m
), h AS (
  SELECT DISTINCT doc_id, i, m, item FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM p) JOIN bw USING (m, win)
), c AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS q FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
