"""Operators that compare documents, and the pipeline, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import jaccard, pii, suffix
from sparkloom.llm.graph import components
from sparkloom.llm.jaccard import jaccard_components, op10_ngram_join
from sparkloom.llm.suffix import op7_suffix_dedup, without_repeats

from .conftest import ordered, rows

sha = lambda x: hashlib.sha256(x).hexdigest()


def shingles(text, k=5):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_components(texts, threshold=80):
    """(doc_id, set size, component) of each row; rows that share an id are one node."""
    sets = [(i, shingles(t)) for i, t in texts]
    up = {i: i for i, _ in sets if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    known = [(i, s) for i, s in sets if i is not None and s]
    by: dict = {}
    for n, (_, s) in enumerate(known):
        for x in s:
            by.setdefault(x, []).append(n)
    for n, (i, s) in enumerate(known):
        for m in {m for x in s for m in by[x] if m < n}:
            j, t = known[m]
            if 100 * len(s & t) >= threshold * len(s | t):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return ordered((i, len(s), None if i is None else root(i)) for i, s in sets)


def test_jaccard(spark, data, texts):
    got = rows(op10_ngram_join(spark, data), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(texts) and sum(i != c for i, _, c in got) > 3


def near_copies(n=400, seed=2):
    """Chains of edits, so that components are larger than cliques; one large family, and short texts."""
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    made, base = [], dice.choices(words, k=120)
    for i in range(n):
        kind = dice.random()
        if kind < 0.45:
            text = list(base)
            for _ in range(dice.randrange(4)):
                text[dice.randrange(len(text))] = dice.choice(words)
        elif kind < 0.75 and made:
            text = dice.choice(made)[1].split()
            if text:
                text[dice.randrange(len(text))] = dice.choice(words)
        else:
            text = dice.choices(words, k=dice.choice([0, 1, 4, 5, 6, 9, 40, 100]))
        made.append((n - i if i % 3 else n + i, " ".join(text)))
    return made


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_jaccard_on_families(spark, monkeypatch, small, seed):
    if small:  # all components go through hubs and blocks
        for name, value in (("TOGETHER", 3), ("BLOCK", 7), ("FREQUENT", 2), ("PAIRED", 2)):
            monkeypatch.setattr(jaccard, name, value)
    made = near_copies(seed=seed)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    assert rows(jaccard_components(df), "doc_id", "n_shingles", "component_id") == brute_components(made)


def test_jaccard_of_pairs_around_frequent_passages(spark):
    """Sets that share a passage of many others, and with one only a few rare elements, which come first in the order."""
    base = " ".join(f"base{i}" for i in range(46))
    side = lambda own, first: [(first + i, f"{base} " + " ".join(f"f{i}x{n}" for n in range(4)) + " " + " ".join(f"{own}{i}x{n}" for n in range(4))) for i in range(200)]
    a, b = side("a", 0), side("b", 1000)
    df = [spark.createDataFrame(x, "doc_id long, text string").coalesce(1) for x in (a, b)]
    got = rows(jaccard_components(df[0].union(df[1])), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(a + b) and sum(i != c for i, _, c in got) == 200


@pytest.mark.parametrize("seed,passage,shared,own", [(1, 80, 13, 11), (2, 40, 12, 6), (3, 160, 13, 21)])
def test_jaccard_of_pairs_around_one_passage(spark, seed, passage, shared, own):
    """All texts share a passage; each two share some words more, which lifts just those two over the threshold."""
    dice = random.Random(seed)
    words = lambda n: [f"w{dice.randrange(10**9)}" for _ in range(n)]
    common, made = words(passage), []
    for pair in range(60):
        both, order = words(shared), dice.random() < 0.5
        for side in range(2):
            start = words(own)
            made.append((2 * pair + side, " ".join(start + (common + both if order else both + common))))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = rows(jaccard_components(df), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(made) and sum(i != c for i, _, c in got) == 60


@pytest.mark.parametrize("together", [1 << 20, 0])
def test_components(spark, monkeypatch, together):
    from sparkloom.llm import graph

    monkeypatch.setattr(graph, "TOGETHER", together)
    dice = random.Random(4)
    edges = [(dice.randrange(300), dice.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)] + [(None, 3), (4, 4)]
    up = list(range(7000))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "component")
    assert got == sorted((n, root(n)) for n in nodes)


def brute_repeats(texts, span):
    where: dict = {}
    bodies = [(t or "").encode() for _, t in texts]
    for body in bodies:
        for i in range(len(body) - span + 1):
            s = body[i : i + span]
            where[s] = where.get(s, 0) + 1
    out = []
    for (doc, _), body in zip(texts, bodies):
        gone = bytearray(len(body))
        for i in range(len(body) - span + 1):
            if where[body[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((doc, len(body), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return ordered(out)


REPEATS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup(spark, data, texts):
    got = rows(op7_suffix_dedup(spark, data), *REPEATS)
    assert got == brute_repeats(texts, 200) and sum(r[2] > 0 for r in got) > 3


def test_suffix_order():
    """The order over all suffixes, with ties of any length, against Python's."""
    dice = random.Random(7)
    for n, letters in ((300, b"ab"), (900, b"a"), (2_000, b"abcd"), (500, bytes(range(256)))):
        data = bytes(dice.choices(letters, k=n))
        data += data[: n // 2] + data[n // 4 :]
        at = np.arange(len(data) - 40 + 1)
        ordered, same = suffix.suffix_order(np.frombuffer(data, np.uint8), at, 40)
        strings = [data[i : i + 40] for i in ordered]
        assert sorted(ordered) == list(at) and strings == sorted(strings)
        assert list(same) == [False] + [a == b for a, b in zip(strings, strings[1:])]


def test_difference_cover():
    for root in (2, 4, 8):
        inside, distance = suffix.difference_cover(root)
        v = root * root
        assert all(inside[(a + distance[a, b]) % v] and inside[(b + distance[a, b]) % v] and distance[a, b] < v for a in range(v) for b in range(v))


@pytest.mark.parametrize("together,slice", [(4_000, 1 << 20), (3, 300), (1, 1 << 20)])
def test_suffix_dedup_on_passages(spark, monkeypatch, together, slice):
    monkeypatch.setattr(suffix, "SLICE", slice)
    dice = random.Random(9)
    noise = lambda n: "".join(dice.choices("abcdeé ", k=n))
    passages = [noise(n) for n in (199, 200, 201, 230, 500, 900)]
    made = [(i, noise(dice.randrange(50)) + "".join(dice.choice(passages) + noise(dice.randrange(3) * 40) for _ in range(dice.randrange(4)))) for i in range(80)]
    made += [(200, "a" * 700), (201, "ab" * 300), (202, "a" * 199), (203, passages[2]), (203, passages[2]), (None, passages[3]), (None, None), (204, "")]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert rows(without_repeats(df, together=together, block=5_000), *REPEATS) == brute_repeats(made, 200)


def test_stages(spark, data):
    import corpus_pipeline as pipeline
    from sparkloom.llm.decontam import op1_decontaminate
    from sparkloom.llm.quality import score_quality, train

    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "redact_pii", "tokenize"]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    stage = dict(pipeline.STAGES)
    whole = lambda df: rows(df, *docs.columns)

    model = train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    kept = score_quality(docs, model, *docs.columns).where(F.col("score") >= 0.7)
    assert whole(stage["quality"](spark, docs, data)) == whole(kept)

    every = [tuple(r) for r in docs.collect()]
    component = {(i, n): c for i, n, c in brute_components([r[:2] for r in every])}
    stays = [r for r in every if r[0] is None or component[r[0], len(shingles(r[1]))] == r[0]]
    assert whole(stage["near_duplicates"](spark, docs, data)) == ordered(stays)

    bad = {r["doc_id"] for r in op1_decontaminate(spark, data).where("contaminated").collect()}
    assert None not in bad and len(bad) >= 3
    assert whole(stage["decontaminate"](spark, docs, data)) == ordered(r for r in every if r[0] not in bad)

    made = []
    for r in every:
        text = None if r[1] is None else pii.redact(r[1], pii.find_spans(r[1]))
        made.append((r[0], text, *r[2:4], None if r[4] is None else len(text or "")))
    assert whole(stage["redact_pii"](spark, docs, data)) == ordered(made)
    assert stage["tokenize"](spark, docs, data).count() == len(every)


def test_stages_with_clashing_columns(spark, data):
    """Columns called what operators use inside come through every stage as they were."""
    import corpus_pipeline as pipeline

    names = ("_no_text", "redacted", "_s_chars", "_text_hash", "_row", "_words", "_keep_doc_id", "fingerprint", "q", "size", "component_id", "label", "_score", "_hit_id")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "n_chars").where("doc_id < 60 or doc_id is null")
    docs = docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(range(len(names)))], name
    assert pipeline.tokenize(spark, docs, data).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline(spark, data, nothing):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert rows(pipeline.run(spark, data), "doc_id", "n_tokens", "ids_sha256") == rows(docs, "doc_id", "n_tokens", "ids_sha256")
    assert pipeline.run(spark, nothing).count() == 0


def test_jaccard_knows_every_frequent_shingle(spark):
    text = " ".join(f"w{i}" for i in range(700_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").coalesce(1)
    bits = jaccard._frequent(docs, 80)
    (_, s), = jaccard.sets_of(pa.array([text]))
    counted = s[: 2 * jaccard.prefix_size(len(s), 80)]
    assert len(counted) > 1 << 18 and jaccard._often(bits, counted).all()
    assert jaccard._often(bits, s[len(counted) :]).mean() < 0.1


def test_jaccard_counts_shingles_over_all_tasks(spark):
    """Shingles that no task meets twice are frequent, too, if more than PAIRED texts have them."""
    n = jaccard.PAIRED + 1
    both = [f"both{i}" for i in range(200)]
    texts = [" ".join([*both, *(f"own{d}x{i}" for i in range(200))]) for d in range(n)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), n), "doc_id long, text string")
    assert docs.rdd.getNumPartitions() == n
    sets = [s for _, s in jaccard.sets_of(pa.array([*texts, " ".join(both)]))]
    everywhere = [np.isin(s[: 2 * jaccard.prefix_size(len(s), 80)], sets[-1]) for s in sets[:-1]]
    shared = set.intersection(*({*s[: len(e)][e].tolist()} for s, e in zip(sets, everywhere)))
    often = jaccard._often(jaccard._frequent(docs, 80), np.array(sorted(shared), np.uint64))
    assert len(shared) > 20 and often.all()
    assert jaccard._often(jaccard._frequent(docs.where(f"doc_id < {n - 1}"), 80), np.array(sorted(shared), np.uint64)).mean() < 0.1


def test_jaccard_moves_texts_of_large_components_in_turns(spark, monkeypatch):
    for name, value in (("TOGETHER", 3), ("BLOCK", 7), ("PAIRED", 2)):
        monkeypatch.setattr(jaccard, name, value)
    made, tables, real = near_copies(n=120, seed=3), [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, what: tables.append(what) or real(df, what))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    assert rows(jaccard_components(df), "doc_id", "n_shingles", "component_id") == brute_components(made)
    assert tables.count("links") > 2


def test_jaccard_matches_elements_in_turns(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MATCHED", 500)
    made, tables, real = near_copies(n=120, seed=4), [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, what: tables.append(what) or real(df, what))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert rows(jaccard_components(df), "doc_id", "n_shingles", "component_id") == brute_components(made)
    assert tables.count("shared") == jaccard.TURNS
