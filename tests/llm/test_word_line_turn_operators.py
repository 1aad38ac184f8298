"""Spelling variants, conversation trie and line dedup against plain versions, and language models without a cut."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import langid, lines, spelling, trie

from .conftest import ordered, rows

WORDS = "word string, n long"


def plain_near(a, b):
    """One edit, by trying all of them."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    found = {}
    near = {w: [o for o in counts if plain_near(w, o)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        found[w] = (n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return found


def variants_of(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def made_words(seed, n, letters="abcdé", low=5, high=9):
    dice = random.Random(seed)
    words = {"".join(dice.choices(letters, k=dice.randrange(low, high))) for _ in range(n)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "abcde", "abcd", "abcdef", "bcdef", "x" * 60, "x" * 61, "x" * 59 + "y", "ÿÿÿÿÿ", "ÿÿÿÿÿÿ"}
    return {w: dice.randrange(1, 40) for w in sorted(words)}


@pytest.mark.parametrize(("share", "longest"), [(spelling.FREQUENT_SHARE, spelling.LIST), (8, 3), (1_000, 10)])
def test_variants_against_all_pairs(spark, monkeypatch, share, longest):
    monkeypatch.setattr(spelling, "FREQUENT_LEAST", 2)
    counts = made_words(share, 500)
    df = spark.createDataFrame(list(counts.items()), WORDS).repartition(4)
    frequent = spelling.frequent_grams(df, share, 2)
    assert share == 8 or frequent  # grams of both lengths are in use
    got = spelling.variants(df, share, longest)
    assert variants_of(got) == plain_variants(counts)


def test_near_words_of_one_edit():
    names = list(made_words(3, 300, "abc", 4, 8))
    i, j = np.triu_indices(len(names), 1)
    assert spelling.near_places(names, i, j).tolist() == [plain_near(names[a], names[b]) for a, b in zip(i, j)]
    assert all(spelling.near(names[a], names[b]) == plain_near(names[a], names[b]) for a, b in zip(i, j))


def test_grams_beside_an_edit_stay():
    """What the lists rest on: an edit takes away no more grams than the bound, and changes none that it doesn't touch."""
    dice = random.Random(8)
    frequent = frozenset("".join(dice.choices("ab\1", k=dice.randrange(2, 4))) for _ in range(9))
    for _ in range(300):
        word = "".join(dice.choices("abc", k=dice.randrange(5, 10)))
        at = dice.randrange(len(word))
        other = dice.choice([word[:at] + word[at + 1 :], word[:at] + "c" + word[at:], word[:at] + "c" + word[at + 1 :]])
        grams = lambda w: Counter(spelling.marked(w)[a:b] for a, b in enumerate(spelling.decompose(spelling.marked(w), frequent)))
        common = (grams(word) & grams(other)).total()
        for w in (word, other):
            ends = spelling.decompose(spelling.marked(w), frequent)
            assert common >= len(ends) - spelling.affected(ends)


def plain_counts(texts):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_op11_on_odd_rows(spark, data, texts):
    counts = plain_counts(texts)
    got = variants_of(spelling.op11_spelling(spark, data))
    assert {w: g[0] for w, g in got.items()} == counts
    near = {w: 0 for w in counts}
    by = {}
    for w in counts:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by.setdefault(key, set()).add(w)
    pairs = {(a, b) for ws in by.values() for a in ws for b in ws if a < b and plain_near(a, b)}
    for a, b in pairs:
        near[a] += 1
        near[b] += 1
    assert {w: g[1] for w, g in got.items()} == near


def test_op11_equals_its_sql(spark, data):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert rows(spelling.op11_spelling(spark, data), "word", "n", "n_near", "form", "form_n", "root") == ordered(c.sql(spelling.OP11_SQL).fetchall())


def test_op11_words_are_cut_at_most_once():
    assert spelling.document_words(5, "Äb ÄB äB", None) == {"Äb": 2, "äb": 1}
    assert spelling.document_words(None, "") == {}


TURNS = "conv_id long, turn long, role string, text string, _row int, digest string"


def plain_trie(conversations):
    own = {}
    for c, turn, role, text in conversations:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c].sort(key=lambda t: (t[0], t[1], t[2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))
    own = {c: [(r, t) for _, _, r, t in ts] for c, ts in own.items()}
    whole = {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + own[c][zlib.crc32(str(c).encode()) % 4 :] for c in own}
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(whole[c]) == len(node)))
        words = lambda m: len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) if m else 0
        leaves = [m for m in below if not any(x[:-1] == m for x in members if x)]
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(m) == len(node) + 1 for m in below), len(leaves), sum((len(members[m]) - 1) * words(m) for m in below), hashlib.sha256(ends.encode()).hexdigest()))
    return ordered(out)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_all_prefixes(spark, tmp_path, seed):
    dice = random.Random(seed)
    made = []
    for c in dice.sample(range(0, 200), 60):
        for turn in range(dice.choice([1, 2, 3, 4, 5, 8, 9, 13])):
            made.append((c, turn, dice.choice(["user", "assistant"]) if turn > 6 else ["user", "assistant"][turn % 2], " ".join(["go on"] * dice.choice([0, 1, 1, 1, 2]))))
    made += [(c, t, "user", f"same {t}") for c in (300, 301, 307, 309, 320, 340) for t in range(14)]  # copies over three blocks and a half
    made += [(60, None, None, None), (60, 0, "user", "x"), (60, 0, "user", "y"), (61, 5, "a", "b c\td"), (None, 0, "user", "lost")]
    spark.createDataFrame([(*r, 7, "d") for r in made], TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = trie.op12_prefix_trie(spark, str(tmp_path))
    assert rows(got, *NODE) == plain_trie(made)


def test_trie_blocks_of_any_size(spark):
    turns = [(c, i, bytes([v]) * 16, 1) for c, vs in enumerate([[1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [1, 2, 3, 9], [1], [7] * 9, []]) for i, v in enumerate(vs)]
    df = spark.createDataFrame(turns, "conv_id long, idx long, digest binary, words long")
    ids = spark.range(6).withColumnRenamed("id", "conv_id")
    found = [rows(trie.prefix_trie(df, ids, block), *NODE) for block in (1, 2, 4, 50)]
    assert all(f == found[0] for f in found) and len(found[0]) == 1 + 5 + 1 + 9


def plain_lines(texts, least_length=20, least_documents=3):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    where = {}
    for doc_id, text in texts:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length and doc_id is not None:
                where.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in texts:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < least_length or len(where.get(key(x), ())) < least_documents or max(where[key(x)]) == doc_id]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return ordered(out)


LINE = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_line_dedup_on_odd_rows(spark, data, texts):
    assert rows(lines.op13_line_dedup(spark, data), *LINE) == plain_lines(texts)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert ordered(c.sql(lines.OP13_SQL).fetchall()) == plain_lines(texts)


@pytest.mark.parametrize(("shard", "light"), [(lines.SHARD, lines.LIGHT), (4, 5)])
def test_line_dedup_shards_and_common_lines(spark, monkeypatch, shard, light):
    monkeypatch.setattr(lines, "LIGHT", light)
    monkeypatch.setattr(lines, "HEAVY", 1_000)
    dice = random.Random(9)
    pool = [f"Line number {i} of many ÄÖ" for i in range(60)] + [" \tThe one that everyone has, here \r", "the ONE that everyone has, here", "short", "", "ä" * 19, "ä" * 20]
    texts = [(i, "\n".join([*dice.sample(pool[:60], dice.randrange(6)), *(pool[60:] if i % 3 else []), f"own line of document {i} alone"])) for i in range(120)]
    texts += [(7, texts[7][1]), (7, "the one that everyone has, here"), (None, texts[9][1]), (None, None), (500, "x\n" + texts[4][1]), (500, texts[4][1])]
    df = spark.createDataFrame([(i, t, 3) for i, t in texts], "doc_id long, text string, lines int").repartition(5)
    got = lines.dedup_lines(df, shard=shard, fields=("n_lines", "n_dropped", "kept_sha256", "kept_text"))
    assert rows(got, *LINE) == plain_lines(texts)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_perfect_hash_has_no_gaps():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1_000, 50_000):
        high, low = r.integers(0, 2**63, n).astype(np.uint64), r.integers(0, 2**63, n).astype(np.uint64)
        arrays = lines.Arrays.of(high, low, np.arange(n), np.arange(n))
        again = lines.Arrays.read(*arrays.packed())
        assert sorted(again.hashed.find(high, low)) == list(range(n))
        there, at = again.look_up(high, low)
        assert there.all() and (again.owners[at] == np.arange(n)).all()
        there, _ = again.look_up(high + np.uint64(1), low)
        assert not there.any()
        if n > 1_000:
            assert sum(map(len, arrays.packed())) < 21 * n  # 20 bytes of arrays and some bits of hash


def test_language_models_keep_every_gram(spark):
    """Texts of a wide alphabet, most of whose n-grams occur once: none of the four orders loses any."""
    dice = random.Random(2)
    han = [(i, "zh", "".join(chr(0x4E00 + dice.randrange(3_000)) for _ in range(400))) for i in range(200)]
    english = [(1_000 + i, "en", " ".join(dice.choices("the of and to in is was for on that with as by".split(), k=40))) for i in range(50)]
    df = spark.createDataFrame([(lang, text) for _, lang, text in han + english], "lang string, text string").repartition(4)
    model = langid.build(df, ["en", "zh"])
    expected = {n: set() for n in range(1, 5)}
    for _, _, text in han + english:
        s = ["", "", "", *re.sub("[^a-z一-鿿]+", " ", text).replace(" ", "\0"), "\0"]
        s = [*s[:3], *("" if c == "\0" else c for c in s[3:])]
        for i in range(3, len(s)):
            for n in expected:
                expected[n].add(tuple(s[i - n + 1 : i + 1]))
    assert {n: model.files[0, 0, n][1] for n in expected} == {n: len(x) for n, x in expected.items()}
    assert model.entropies([han[0][2], english[0][2]])[0].argmin(axis=1).tolist() == [1, 0]
    out = langid.predict(df.withColumn("doc_id", F.lit(1).cast("long")), model)
    assert out.where("lang_pred <> 'und'").groupBy("lang_pred").count().collect() and "folder" in model.__dict__ and len(repr(model)) < 5_000
