"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased, each run of other characters than letters becomes one
boundary, and n-grams of up to ORDER symbols are counted by language in Spark,
which also makes of them continuation counts, discounted shares, weights for
backing off and, order by order, interpolated probabilities. All n-grams of the
sample are kept. GROUP languages share a set of arrays: sorted n-gram hashes with
a row of log probabilities, a column for each language, and sorted context hashes
with log weights. Tasks write these arrays as files in the shared folder, row by
row from a sorted table, and workers map them into memory; the driver has their
names only. A text's cross-entropy is the mean over its symbols; the language
with the lowest wins. A prediction is accepted if that entropy is no higher than
what texts of the language show that were kept out of the counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import KEPT_IN_WORKER, discard, in_worker, shared_dir, written

ORDER, DISCOUNT, SYMBOLS = 4, 0.75, 4096
#: Training documents of a language: its labelled sample.
DOCUMENTS = 1_000
#: Languages that share arrays.
GROUP = 8
#: One in so many documents of the sample is kept out of the counts, and the nats above its entropies (all but one in 200) that are still accepted.
KEPT_OUT, MARGIN = 5, 0.25
K = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 20
#: Leading bits of a hash by which sorted hashes are entered, at most.
ENTER = 20
END, TOP = np.uint64(2**64 - 1), np.uint64(1 << 63)

_LETTERS = None


def letters() -> np.ndarray:
    """Which code points are letters; made once in a worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols in one array, three boundaries before each text, and the places where texts start and the last ends."""
    lows = [f"\0\0\0{t.lower()}\0" for t in texts]
    cps = np.frombuffer("".join(lows).encode("utf-32-le", "replace"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in lows])]).astype(np.int64)
    is_letter = letters()[cps]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    for d in range(3):
        keep[starts[:-1] + d] = True
    at = np.concatenate([[0], np.cumsum(keep)])[starts]
    return np.where(is_letter, cps, 0)[keep].astype(np.uint64), at


def gram_hashes(s: np.ndarray) -> list[np.ndarray]:
    """For each order the hash of the n-gram that ends at a place (of no use at the first n - 1)."""
    out = [s]
    for _ in range(ORDER - 1):
        h = np.zeros(len(s), np.uint64)
        h[1:] = out[-1][:-1] * K
        out.append(h + s)
    return out


def _scored(at: np.ndarray, n: int) -> np.ndarray:
    """Marks the places that count: all but the three boundaries before a text."""
    out = np.ones(n, bool)
    for d in range(3):
        out[at[:-1] + d] = False
    return out


def in_slices(texts: list[str]):
    """Ranges of texts of about SLICE characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@dataclass
class HashArray:
    """Sorted hashes with END behind them, entered by their leading bits."""

    keys: np.ndarray
    shift: int
    starts: np.ndarray

    def find(self, mixed: np.ndarray) -> np.ndarray:
        """Places of mixed hashes, or -1."""
        at = self.starts[(mixed >> np.uint64(self.shift)).astype(np.int64)].astype(np.int64)
        out = np.where(self.keys[at] == mixed, at, -1)
        left = np.flatnonzero(self.keys[at] < mixed)
        while len(left):
            at[left] += 1
            key, want = self.keys[at[left]], mixed[left]
            out[left[key == want]] = at[left[key == want]]
            left = left[key < want]
        return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads hashes evenly, one to one; the largest number stands for the end."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Arrays:
    """The model of up to GROUP languages."""

    grams: list[HashArray]
    log_probs: list[np.ndarray]
    contexts: list[HashArray]
    log_weights: list[np.ndarray]

    def logs(self, hashes: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        out = np.zeros((len(places), self.log_weights[0].shape[1]), np.float32)
        left = np.arange(len(places))
        for n in range(ORDER, 0, -1):
            found = self.grams[n - 1].find(mix(hashes[n - 1][places[left]]))
            hit = found >= 0
            out[left[hit]] += self.log_probs[n - 1][found[hit]]
            left = left[~hit]
            if not len(left):
                break
            if n == 1:
                out[left] -= np.float32(np.log(SYMBOLS))
                if len(self.log_weights[0]):
                    out[left] += self.log_weights[0][0]
            else:
                seen = self.contexts[n - 1].find(mix(hashes[n - 2][places[left] - 1]))
                known = seen >= 0
                out[left[known]] += self.log_weights[n - 1][seen[known]]
        return out


#: Arrays that a worker has open.
_OPEN: dict[str, Arrays] = {}
KEPT_IN_WORKER["langid"] = _OPEN


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _mapped(store, path: str, kind, shape) -> np.ndarray:
    """A file as an array: mapped where the shared folder is mounted, else read."""
    if not int(np.prod(shape)):
        return np.zeros(shape, kind)
    if store.type_name == "local":
        return np.memmap(path, kind, "r", shape=shape)
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), kind).reshape(shape)


@dataclass
class Model:
    """languages; folder and files: by group of languages, kind (0: n-grams, 1: contexts) and order the name of a file and its number of hashes; limits of accepted entropies."""

    languages: list[str]
    folder: str
    files: dict[tuple[int, int, int], tuple[str, int]]
    limits: list[float]

    def arrays(self, group: int) -> Arrays:
        name = f"{self.folder}/{group}"
        if name not in _OPEN:
            store, base = _store(self.folder)
            if store.type_name != "local":
                _OPEN.clear()  # what isn't mapped is held for one group at a time
            wide = len(self.languages[group * GROUP : (group + 1) * GROUP])
            made = Arrays([], [], [], [])
            for n in range(1, ORDER + 1):
                for kind, arrays, logs in ((0, made.grams, made.log_probs), (1, made.contexts, made.log_weights)):
                    file, size = self.files.get((group, kind, n), (None, 0))
                    bits = entering_bits(size)
                    if file:
                        arrays.append(HashArray(_mapped(store, f"{base}/{file}.keys", np.uint64, (size + 1,)), 64 - bits, _mapped(store, f"{base}/{file}.starts", np.int64, (1 << bits,))))
                        logs.append(_mapped(store, f"{base}/{file}.logs", np.float32, (size, wide)))
                    else:
                        arrays.append(HashArray(np.array([END]), 64 - bits, np.zeros(1 << bits, np.int64)))
                        logs.append(np.zeros((0, wide), np.float32))
            _OPEN[name] = made
        return _OPEN[name]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability by text and language, and the number of symbols; no symbols: zeros."""
        n_langs = len(self.languages)
        out, sizes = np.zeros((len(texts), n_langs)), np.zeros(len(texts), np.int64)
        for a, b in in_slices(texts):
            s, at = symbols(texts[a:b])
            scored = _scored(at, len(s))
            hashes = gram_hashes(s)
            total = np.concatenate([[0], np.cumsum(scored)])
            count = np.diff(total[at])
            places = np.flatnonzero(scored)
            for group in range(-(-n_langs // GROUP)):
                logs = self.arrays(group).logs(hashes, places)
                sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0, dtype=np.float64)])[total[at]]
                out[a:b, group * GROUP : group * GROUP + logs.shape[1]] = -np.diff(sums, axis=0) / np.maximum(count, 1)[:, None]
            sizes[a:b] = count
        return out, sizes


def entering_bits(n: int) -> int:
    return max(1, min(ENTER, int(n * 2).bit_length()))


COUNTS = "lang string, n int, gram long, context long, suffix long, count long"


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, n, gram, context and suffix (their mixed hashes, less 2^63, so that they sort as they are), count, over rows of lang and text."""

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = np.array([t or "" for t in batch.column(1).to_pylist()], object)
            for lang in sorted(set(langs)):
                own = list(texts[langs == lang])
                for a, b in in_slices(own):
                    s, at = symbols(own[a:b])
                    places = np.flatnonzero(_scored(at, len(s)))
                    hashes = gram_hashes(s)
                    for n in range(1, ORDER + 1):
                        grams, first, counts = np.unique(hashes[n - 1][places], return_index=True, return_counts=True)
                        p = places[first]
                        zero = np.zeros(len(p), np.uint64)
                        columns = [grams, hashes[n - 2][p - 1] if n > 1 else zero, hashes[n - 2][p] if n > 1 else zero]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(p), pa.string()), pa.array(np.full(len(p), n, np.int32)), *(pa.array((mix(c) ^ TOP).view(np.int64)) for c in columns), pa.array(counts.astype(np.int64))],
                            names=[x.split()[0] for x in COUNTS.split(", ")],
                        )

    return labelled.select("lang", "text").mapInArrow(count, COUNTS).groupBy("lang", "n", "gram").agg(F.max("context").alias("context"), F.max("suffix").alias("suffix"), F.sum("count").alias("count"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From COUNTS: the discounted share of each n-gram among those of its context, and the weight of each context's lower order.

    Below the highest order it counts how many symbols an n-gram follows.
    """
    kinds = counts.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("suffix").alias("gram")).agg(F.count("*").alias("kinds"))
    adjusted = F.when(F.col("n") == ORDER, F.col("count")).otherwise(F.coalesce("kinds", F.lit(0)))
    rows = counts.join(kinds, ["lang", "n", "gram"], "left").select("lang", "n", "gram", "context", "suffix", adjusted.alias("count"))
    contexts = rows.groupBy("lang", "n", "context").agg(F.sum("count").alias("total"), F.count_if(F.col("count") > 0).alias("kinds"))
    shares = rows.join(contexts, ["lang", "n", "context"]).withColumn("share", F.when(F.col("total") > 0, F.greatest(F.col("count") - DISCOUNT, F.lit(0)) / F.col("total")).otherwise(0.0))
    weights = contexts.withColumn("weight", F.when(F.col("total") > 0, F.col("kinds") * DISCOUNT / F.col("total")).otherwise(1.0))
    return shares.select("lang", "n", "gram", "context", "suffix", "share"), weights.select("lang", "n", "context", "weight")


def interpolated(shares: DataFrame, weights: DataFrame, languages: list[str]) -> DataFrame:
    """lang_group, kind (0: n-grams, 1: contexts), n, key and a column for each place in a group: probabilities of n-grams, weights of contexts."""
    number = F.create_map(*(F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)))[F.col("lang")]
    wide = range(min(GROUP, len(languages)))
    placed = lambda df: df.withColumn("_no", number).withColumns({"lang_group": F.floor(F.col("_no") / GROUP).cast("int"), "_slot": F.col("_no") % GROUP})
    of = lambda column, i, none: F.coalesce(F.max(F.when(F.col("_slot") == i, F.col(column))), F.lit(none))
    grams = placed(shares).groupBy("lang_group", "n", "gram").agg(F.max("context").alias("context"), F.max("suffix").alias("suffix"), *(of("share", i, 0.0).alias(f"s{i}") for i in wide))
    backs = placed(weights).groupBy("lang_group", "n", "context").agg(*(of("weight", i, 1.0).alias(f"b{i}") for i in wide))
    grams, backs = written(grams, "grams"), written(backs, "contexts")
    orders, lower = [], None
    for n in range(1, ORDER + 1):
        own = grams.where(F.col("n") == n).join(backs.where(F.col("n") == n).drop("n"), ["lang_group", "context"], "left")
        if lower is None:
            below = [F.lit(1.0 / SYMBOLS) for _ in wide]
        else:
            own = own.join(lower.select("lang_group", F.col("key").alias("suffix"), *(F.col(f"v{i}").alias(f"l{i}") for i in wide)), ["lang_group", "suffix"], "left")
            below = [F.coalesce(f"l{i}", F.lit(1.0 / SYMBOLS)) for i in wide]
        lower = written(own.select("lang_group", F.lit(0).alias("kind"), "n", F.col("gram").alias("key"), *((F.col(f"s{i}") + F.coalesce(f"b{i}", F.lit(1.0)) * below[i]).alias(f"v{i}") for i in wide)), "probabilities")
        orders.append(lower)
    out = backs.select("lang_group", F.lit(1).alias("kind"), "n", F.col("context").alias("key"), *(F.col(f"b{i}").alias(f"v{i}") for i in wide))
    for order in orders:
        out = out.unionByName(order)
    out._read = [grams, backs, *orders]
    return out


FILES = "lang_group int, kind int, n int, size long, file string"


def write_arrays(rows: DataFrame, languages: list[str], folder: str) -> dict[tuple[int, int, int], tuple[str, int]]:
    """Writes rows of interpolated() as sorted arrays below folder: by group, kind and order the name of the files and the number of hashes.

    A file is written by the task that reads its rows, batch by batch, under a
    name of its own, so that a task that is run again leaves no half file that is
    read. A row for each file goes to the driver.
    """
    last = (len(languages) - 1) // GROUP
    rest = len(languages) - last * GROUP

    def write(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        at, streams, name, size, seen = None, [], "", 0, None

        def close():
            streams[0].write(np.array([END]).tobytes())
            bits = entering_bits(size)
            starts = np.concatenate([[0], np.cumsum(seen.reshape(1 << bits, -1).sum(axis=1))[:-1]])
            with store.open_output_stream(f"{base}/{name}.starts") as out:
                out.write(starts.astype(np.int64).tobytes())
            for s in streams:
                s.close()
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in at), pa.array([size]), pa.array([name])], names=[x.split()[0] for x in FILES.split(", ")])

        for batch in batches:
            which = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]).any(axis=1)])) if len(which) else []
            for a, b in zip(edges, [*edges[1:], len(which)]):
                if at != tuple(which[a]):
                    if at is not None:
                        yield close()
                    at, name, size, seen = tuple(int(x) for x in which[a]), uuid.uuid4().hex, 0, np.zeros(1 << ENTER, np.int64)
                    streams = [store.open_output_stream(f"{base}/{name}.{x}") for x in ("keys", "logs")]
                keys = batch.column(3).to_numpy()[a:b].view(np.uint64) ^ TOP
                wide = rest if at[0] == last else GROUP
                values = np.stack([batch.column(4 + i).to_numpy()[a:b] for i in range(wide)], axis=1)
                streams[0].write(keys.tobytes())
                streams[1].write(np.log(np.maximum(values, 1e-30)).astype(np.float32).tobytes())
                seen += np.bincount((keys >> np.uint64(64 - ENTER)).astype(np.int64), minlength=1 << ENTER)
                size += b - a
        if at is not None:
            yield close()

    dealt = rows.repartition("lang_group", "kind", "n").sortWithinPartitions("lang_group", "kind", "n", "key")
    return {(r["lang_group"], r["kind"], r["n"]): (r["file"], r["size"]) for r in dealt.mapInArrow(in_worker("langid")(write), FILES).collect()}


def build(labelled: DataFrame, languages: list[str]) -> Model:
    """A model of the languages from rows of lang and text: of all their n-grams."""
    folder = shared_dir(labelled.sparkSession, "language-arrays")
    counts = written(count_grams(labelled), "counts")
    rows = interpolated(*kneser_ney(counts), languages)
    files = write_arrays(rows, languages, folder)
    discard(counts, *rows._read)
    return Model(languages, folder, files, [0.0] * len(languages))


def train(documents: DataFrame, learn, per_language: int = DOCUMENTS) -> Model:
    """From rows that satisfy learn and have a lang: of each language about per_language, those with the smallest hashes of id and text.

    All languages are learned; one without a letter in its counted sample, or
    whose texts are all kept out of the counts, has the same low probability for
    every symbol.
    """
    rows = documents.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], "", {}, [])
    bound = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, per_language / n) * (1 << 30)))))
    mixed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    chosen = written(rows.where(mixed < bound[F.col("lang")]).withColumn("out", F.pmod(F.xxhash64("text", "doc_id"), F.lit(KEPT_OUT)) == 0), "sample")
    model = build(chosen.where("not out"), sorted(counts))
    own = predict(chosen.where("out").withColumn("doc_id", F.lit(0).cast("long")), model).where("lang_pred <> 'und'")
    limits = {r["lang_pred"]: r["q"] for r in own.groupBy("lang_pred").agg(F.percentile_approx("entropy", 0.995).alias("q")).collect()}
    every = max(limits.values(), default=0.0)  # of a language with no text kept out
    discard(chosen)
    model.limits = [limits.get(x, every) + MARGIN for x in model.languages]
    return model


PREDICTED = "doc_id long, lang_pred string, score double, entropy double, accepted boolean"


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """One row per row of documents: doc_id, lang_pred, score, entropy (nats a symbol), accepted.

    lang_pred is und where a text is null or has no letter, or no language was
    learned; score is then 0 and accepted false. Otherwise score is the share of
    the winner if languages were weighed by entropy over up to 50 symbols. Equal
    entropies: the first by name. Null doc_ids stay, repeated rows repeat.
    """

    def run(batches):
        limits = np.array(model.limits)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = len(texts)
            if model.languages:
                entropies, sizes = model.entropies(texts)
            else:
                entropies, sizes, limits = np.zeros((n, 1)), np.zeros(n, np.int64), np.zeros(1)
            best = entropies.argmin(axis=1) if n else np.zeros(0, np.int64)
            low = entropies[np.arange(n), best]
            none = sizes == 0
            score = 1.0 / np.exp(-(entropies - low[:, None]) * np.minimum(sizes, 50)[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(["und" if e else model.languages[b] for e, b in zip(none, best)], pa.string()),
                    pa.array(np.where(none, 0.0, score)),
                    pa.array(np.where(none, 0.0, low)),
                    pa.array(~none & (low <= limits[best])),
                ],
                names=[x.split()[0] for x in PREDICTED.split(", ")],
            )

    return documents.select("doc_id", "text").mapInArrow(in_worker("langid")(run), PREDICTED)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import table
    from .quality import held_out

    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(documents, ~held_out(F.col("doc_id"), 5, 0))
    out = predict(documents, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "entropy", "accepted")
