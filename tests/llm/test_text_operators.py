"""Operators on single rows, against plain Python or the library they have to agree with."""

import hashlib
import random
import re
from array import array
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, pii, quality, rules, warc
from sparkloom.llm.bpe import op4_bpe
from sparkloom.llm.chat import op2_chat_format
from sparkloom.llm.decontam import op1_decontaminate
from sparkloom.llm.langid import op6_language_id
from sparkloom.llm.pii import op8_pii
from sparkloom.llm.quality import op3_quality_classifier
from sparkloom.llm.queries import QUERIES
from sparkloom.llm.rules import op5_quality_rules
from sparkloom.llm.warc import op9_warc

from .conftest import crc, ordered, rows

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    found = QUERIES[name](spark, nothing).collect()
    assert len(found) == (1 if name.startswith("op2_") else 0)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_decontaminate(spark, data, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = pq.read_table(f"{data}/benchmark.parquet").to_pydict()
    windows: dict = {}
    for item, text in zip(items["item_id"], items["text"]):
        w = words(text)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    want = []
    for doc, text in texts:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    found |= own
        want.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    got = rows(op1_decontaminate(spark, data), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == ordered(want) and any(r[5] for r in got)


def test_decontaminate_shuffled_side_and_short_items(spark, monkeypatch):
    from sparkloom.llm import decontam

    benchmark = spark.createDataFrame([(1, "Alpha beta"), (1, "gamma"), (None, "delta delta delta"), (2, None), (3, "?!"), (4, " ".join(f"w{i}" for i in range(14)))], "item_id long, text string")
    documents = spark.createDataFrame([(1, "x ALPHA, beta. alpha delta delta delta delta"), (2, "y " + " ".join(f"W{i}" for i in range(3, 14)) + " z"), (3, "gamma"), (4, None)], "doc_id long, text string")
    for small, bits in ((100_000, 1 << 22), (0, 64)):  # broadcast; a shuffle, and a map that lets nearly all pass
        monkeypatch.setattr(decontam, "SMALL", small)
        monkeypatch.setattr(decontam, "BITS_LEAST", min(bits, 1 << 14))
        monkeypatch.setattr(decontam, "BITS_MOST", bits)
        got = rows(decontam.contamination(documents, benchmark, "doc_id"), "doc_id", "n_words", "n_hit", "n_items", "items")
        assert got == [(1, 8, 6, 2, ["", "1"]), (2, 13, 11, 1, ["4"]), (3, 1, 1, 1, ["1"]), (4, 0, 0, 0, [])]


def test_decontaminate_repetitive_texts(spark):
    """Few words, so that windows have many equal grams and fingerprints many places."""
    from sparkloom.llm import decontam

    dice = random.Random(8)
    made = [(i, " ".join(dice.choices("ab", [5, 1], k=dice.randrange(1, 60)))) for i in range(60)]
    items = [(i, " ".join(dice.choices("ab", [5, 1], k=dice.randrange(1, 25)))) for i in range(8)]
    windows: dict = {}
    for i, text in items:
        w = text.split()
        for at in range(len(w) - min(10, len(w)) + 1):
            windows.setdefault(tuple(w[at : at + 10]), set()).add(str(i))
    want = []
    for doc, text in made:
        w, hit, found = text.split(), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if own := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    found |= own
        want.append((doc, len(w), len(hit), sorted(found)))
    frames = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontam.contamination(*frames, "doc_id"), "doc_id", "n_words", "n_hit", "items") == want


def test_chat(spark, data):
    table = pq.read_table(f"{data}/conversations.parquet").to_pydict()
    by: dict = {-7: [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]}
    for conv, turn, role, text in zip(table["conv_id"], table["turn"], table["role"], table["text"]):
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    want = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    assert rows(op2_chat_format(spark, data), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == ordered(want)


def test_chat_round_trip(spark):
    parts = ["<turn>", "</turn>", "</turn>\n", "<\\/turn>", "\\", "\n", "\r", "a", "$1", "", "assistant\n", " ", "😀", "\0"]
    dice = random.Random(5)
    made = [(c, t, "".join(dice.choices(parts, k=dice.randrange(4))), "".join(dice.choices(parts, k=dice.randrange(9)))) for c in range(300) for t in range(dice.randrange(1, 5))]
    made += [(None, 1, None, None), (None, None, "user", "x"), (None, 1, "user", "x"), (None, 1, "user", "x")]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_conversations(df)).collect()
    by: dict = {}
    for conv, turn, role, text in made:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["parsed"]] for r in out} == {c: [t[2:] for t in sorted(v)] for c, v in by.items()}


def test_bpe(spark, data, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_tokenizer())
    plain.no_truncation()
    plain.no_padding()
    want = []
    for doc, text in texts:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(array("I", ids).tobytes()), sha(plain.decode(ids, skip_special_tokens=False))))
    assert rows(op4_bpe(spark, data), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(want)


def test_bpe_on_noise():
    from tokenizers import Tokenizer

    plain, own, dice = Tokenizer.from_file(bpe.default_tokenizer()), bpe.load(bpe.default_tokenizer()), random.Random(3)
    letters = [" ", " ", "\n", "\t", " ", "a", "e", "th", "ing", "'s", "'", "é", "ß", "ж", "中", "٣", "7", "!", "--", "‍", "😀", "<|endoftext|>", "Ω", "́", "zz", "\r\n"]
    made = ["".join(dice.choices(letters, k=dice.randrange(40))) for _ in range(3_000)] + ["a" * 3_000, "ab" * 1_000, " " * 500, "=" * 999, "\n" * 300 + "x"]
    for text, ids in zip(made, own.encode_batch(made)):
        want = plain.encode(text, add_special_tokens=False).ids
        assert list(array("I", ids)) == want, text
        assert own.decode(ids) == plain.decode(want, skip_special_tokens=False)


def test_quality_rules(spark, data, texts):
    want = []
    for doc, text in texts:
        words, lines = re.findall("[^\x20\x09-\x0d]+", text or ""), (text or "").split("\n")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        again = {i + d for i, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in lines:
            dup += bool(line in seen and re.search("[^\x20\x09-\x0d]", line))
            seen.add(line)
        want.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)))
    found = op5_quality_rules(spark, data)
    assert rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == ordered(want)
    assert found.where("base_failed and kept").isEmpty()


def test_compression_bands():
    import zstandard

    pack, dice = zstandard.ZstdCompressor(level=rules.LEVEL).compress, random.Random(1)
    vocabulary = ["".join(dice.choices("etaoinshrdlucmfwyp", k=dice.randrange(2, 9))) for _ in range(3_000)]
    prose = lambda n: " ".join(dice.choices(vocabulary, k=n))
    verdict = lambda t: rules.compression_verdict(t if isinstance(t, bytes) else t.encode(), pack)[2]
    assert all(verdict(prose(n)) for n in (5, 60, 300, 2_000, 20_000)) and verdict("")
    assert not verdict("buy now " * 400) and not verdict(dice.randbytes(5_000))
    assert not verdict(prose(2_000) + dice.randbytes(60_000).hex() * 3)
    assert not verdict(prose(1_300)[:7_000].encode() + dice.randbytes(3_000))  # noise behind the last full chunk


def test_kept_by_rules(spark, data, texts):
    import zstandard

    pack = zstandard.ZstdCompressor(level=rules.LEVEL).compress

    def passes(data):
        in_band = lambda x, low, high: low <= len(pack(x)) / len(x) <= high
        of_length = lambda x: max(b for b in rules.BANDS if b[0] <= len(x))[1:]
        chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else []
        bad = [c for c in chunks if not in_band(c, *((0.28, 0.75) if len(c) == 4096 else of_length(c)))]
        return not data or (in_band(data, *of_length(data)) and 4 * len(bad) <= len(chunks))

    found = op5_quality_rules(spark, data).select("doc_id", "base_failed", "kept").collect()
    failed = {(r["doc_id"], r["base_failed"]) for r in found}
    want = [(doc, passes((text or "").encode()) and (doc, True) not in failed) for doc, text in texts if doc is not None]
    assert ordered((r["doc_id"], r["kept"]) for r in found if r["doc_id"] is not None) == ordered(want)


def test_quality_classifier(spark):
    folder = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in op3_quality_classifier(spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (crc(i, 4) == 2) for i, r in out.items())
    held = [(out[i]["score"], q) for i, q in zip(labels["doc_id"], labels["quality"]) if out[i]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9, auc


def test_quality_on_odd_rows(spark, data, texts):
    got = op3_quality_classifier(spark, data).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False, False]


def test_score_against_plain_python(spark, data, texts):
    import math
    import unicodedata

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    bounds = {"chars": 500, "upper": 0.02, "digits": 0.01, "stops": 0.015, "calls": 0.002, "signs": 0.01, "bars": 0.001, "breaks": 0.005, "words": 80, "distinct": 0.6, "same_as_next": 0.01, "word_length": 6.0}
    own = tuple(quality.Rule(((name, i % 2 == 0, float(at)),), 2.0**-i) for i, (name, at) in enumerate(bounds.items()))  # each weight shows in the sum
    model = quality.RuleEnsemble(model.intercept / 4, model.rules + own)

    def score(text):
        n = max(len(text), 1)
        words = re.split("[ \t\n\x0b\f\r]+", text)
        share = lambda wanted: sum(map(wanted, text)) / n
        values = {
            "chars": len(text), "upper": share(lambda c: unicodedata.category(c) == "Lu"), "digits": share(lambda c: c in "0123456789"), "stops": share(lambda c: c in ".,"), "calls": share(lambda c: c in "!?"),
            "signs": share(lambda c: c in "#$%&*+=<>|{}[]\\^~@_/"), "bars": share(lambda c: c == "|"), "breaks": share(lambda c: c == "\n"), "words": len(words), "distinct": len(set(words)) / len(words),
            "same_as_next": sum(a == b for a, b in zip(words, words[1:])) / len(words), "word_length": len(text) / len(words),
        }
        fires = lambda r: all(values[name] <= at if below else values[name] > at for name, below, at in r.terms)
        return 1 / (1 + math.exp(-model.intercept - sum(r.weight for r in model.rules if fires(r))))

    got = {r["_row"]: r["score"] for r in quality.score_quality(docs.withColumn("_row", F.monotonically_increasing_id()), model, "_row").collect()}
    numbered = docs.withColumn("_row", F.monotonically_increasing_id()).collect()
    assert len(numbered) == len(texts) and all(got[r["_row"]] == pytest.approx(score(r["text"] or ""), abs=1e-9) for r in numbered)


def test_rules_from_trees():
    debug = "  Tree 0 (weight 1.0):\n    If (feature 0 <= 5.0)\n     If (feature 1 > 0.25)\n      Predict: 1.0\n     Else (feature 1 <= 0.25)\n      Predict: 0.0\n    Else (feature 0 > 5.0)\n     Predict: 0.0\n"
    assert quality.tree_rules(debug, ("a", "b")) == {(("a", True, 5.0),), (("a", True, 5.0), ("b", False, 0.25)), (("a", True, 5.0), ("b", True, 0.25)), (("a", False, 5.0),)}


def test_language_id(spark):
    folder = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in op6_language_id(spark, folder).collect()}
    t = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    held = [(out[i]["lang_pred"], lang) for i, lang, text in zip(t["doc_id"], t["lang"], t["text"]) if crc(i, 5) == 0 and lang and len(text or "") > 40]
    assert all(r["held_out"] == (crc(i, 5) == 0) and 0 <= r["score"] <= 1 for i, r in out.items())
    assert sum(a == b for a, b in held) / len(held) > 0.97


def plain_entropy(training, text, order=4, discount=0.75, symbols=4096):
    """Interpolated Kneser-Ney with dicts."""
    import math

    def of(t):
        out = []
        for c in t.lower():
            if c.isalpha():
                out.append(c)
            elif out and out[-1]:
                out.append("")
        return [""] * 3 + (out if out and not out[-1] else [*out, ""] if out else out)

    counts = {n: Counter() for n in range(1, order + 1)}
    for t in training:
        s = of(t)
        for i in range(3, len(s)):
            for n in counts:
                counts[n][tuple(s[i - n + 1 : i + 1])] += 1
    for n in range(1, order):
        after = Counter(g[1:] for g in counts[n + 1])
        counts[n] = {g: after[g] for g in counts[n]}
    totals = {n: Counter() for n in counts}
    kinds = {n: Counter() for n in counts}
    for n, c in counts.items():
        for g, x in c.items():
            totals[n][g[:-1]] += x
            kinds[n][g[:-1]] += x > 0

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / symbols
        total = totals[n][g[:-1]]
        return max(counts[n].get(g, 0) - discount, 0) / total + discount * kinds[n][g[:-1]] / total * p(g[1:]) if total else p(g[1:])

    s = of(text)
    return -sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(3, len(s))) / max(1, len(s) - 3)


def test_language_models_against_dicts(spark, monkeypatch):
    from sparkloom.llm import langid

    monkeypatch.setattr(langid, "GROUP", 2)
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["lang", "text"]).to_pydict()
    rows_ = [(lang, text[:600]) for lang, text in zip(t["lang"], t["text"]) if lang and text][:60]
    languages = sorted({lang for lang, _ in rows_})
    model = langid.build(spark.createDataFrame(rows_, "lang string, text string"), languages)
    texts = [x for _, x in rows_[:6]] + ["Zebra, quux! 12 ñandú", "a"]
    got, _ = model.entropies(texts)
    for i, text in enumerate(texts):
        for j, lang in enumerate(languages):
            assert got[i, j] == pytest.approx(plain_entropy([x for own, x in rows_ if own == lang], text), abs=1e-4)


def test_language_id_learns_every_language(spark):
    """Eighty invented languages of few texts, each with letters of its own frequency."""
    from sparkloom.llm import langid

    dice = random.Random(6)
    speech = [dice.choices("abcdefghijklmnopqrstuvwxyz", [dice.random() ** 4 for _ in range(26)], k=400) for _ in range(80)]
    say = lambda i: " ".join("".join(dice.choices(speech[i], k=dice.randrange(2, 9))) for _ in range(60))
    made = [(n * 100 + i, f"x{i:02}", say(i)) for n in range(12) for i in range(80)]
    model = langid.train(spark.createDataFrame(made, "doc_id long, lang string, text string").repartition(4), F.lit(True))
    assert len(model.languages) == 80
    got, _ = model.entropies([say(i) for i in range(80)])
    assert (got.argmin(axis=1) == range(80)).mean() > 0.95


def test_language_id_on_odd_rows(spark, data, texts):
    got = op6_language_id(spark, data).collect()
    assert len(got) == len(texts)
    none = {i for i, t in texts if i and not any(c.isalpha() for c in t or "")}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in none) for r in got if r["doc_id"])
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(m)))) % 10 == 0]
    found += [("phone", m) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(((k, *m.span()) for k, m in found), key=lambda x: (x[1], pii.BASE.index(x[0])))


def test_pii(spark, data, texts):
    want = []
    for doc, text in texts:
        spans = base_spans(text or "")
        want.append((doc, *(sum(s[0] == k for s in spans) for k in pii.BASE), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    found = op8_pii(spark, data)
    assert rows(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == ordered(want)


def test_pii_on_noise():
    dice = random.Random(11)
    letters = ["1", "4111", "0", "12", "255", "256", ".", ".", "-", " ", " ", "@", "a", "b.c", "+", "+1", "(", ")", "İ", "é", "٣", "_", "%", "\n", "10.0.0.1", "4111 1111 1111 1111", "www.", "token: "]
    for _ in range(20_000):
        text = "".join(dice.choices(letters, k=dice.randrange(30)))
        spans = pii.find_spans(text)
        assert [s for s in spans if s[0] in pii.BASE] == base_spans(text), repr(text)
        assert spans == sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_adds_and_redacts():
    text = "See https://example.org/x?y=1. My account: AB-12345678, mail me@site.co.uk!"
    spans = pii.find_spans(text)
    assert [k for k, _, _ in spans] == ["url", "account", "email"]
    assert pii.redact(text, spans) == "See [URL]. My account: [ACCOUNT], mail [EMAIL]!"


def test_warc(spark, data, tmp_path):
    t = pq.read_table(f"{data}/pages.parquet").to_pydict()
    pages = list(zip(t["page_id"], t["url"], t["html"]))
    extra = [(9001, "u\r\nx", "é" * 80), (9003, None, "é" * 80), (9002, "u", "é" * 80), (9004, "u", None), (9005, "u", ""), (9006, "u", "q" * 99), (9007, "u", "q" * 99), (9008, "u", "q" * 100), (9009, "u", "q" * 100), (None, "u", "q" * 100), (9010, "u", "WARC/1.1\r\n\r\n" * 9)]
    pages += extra
    folder = tmp_path / "in"
    folder.mkdir()
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    first: dict = {}
    for page, _, html in pages:
        body = (html or "").encode()
        if page is not None and len(body) >= 100:
            first[body] = min(first.get(body, page), page)
    want = []
    for page, _, html in pages:
        body = (html or "").encode()
        again = body in first and first[body] != page
        want.append((page, len(body), sha(body), "revisit" if again else "response", first[body] if again else None))
    assert rows(op9_warc(spark, str(folder)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == ordered(want)


def test_warc_reads_what_is_selected(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE", 2_000)  # several archives a task
    monkeypatch.setattr(warc, "TASK", 1_000)
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 40) for i in range(200)], "page_id long, url string, html string")
    index = warc.archive(pages, str(tmp_path))
    some = index.where("page_id % 7 = 3")
    got = rows(warc.read_archives(some, str(tmp_path), payloads=True), "page_id", "url", "payload")
    assert [(a, b, bytes(c)) for a, b, c in got] == [(i, f"u{i}", (f"<p>{i}</p>" * 40).encode()) for i in range(200) if i % 7 == 3]
    import gzip

    files = list((tmp_path / "archives").glob("*.warc.gz"))
    texts = [gzip.decompress(f.read_bytes()).decode() for f in files]  # each archive is a whole gzip file
    ids = re.findall(r"WARC-Record-ID: (\S+)", "".join(texts))
    assert len(files) > 8 and all(t.startswith("WARC/1.1\r\nWARC-Type: warcinfo") for t in texts)
    assert len(ids) == len(set(ids)) == 200 + len(files)


def test_workers_let_go_of_what_others_kept(monkeypatch):
    import pickle

    from pyspark import cloudpickle

    from sparkloom.llm import _shared

    mine, theirs = {"a": 1}, {"b": 2}
    monkeypatch.setitem(_shared.KEPT_IN_WORKER, "mine", mine)
    monkeypatch.setitem(_shared.KEPT_IN_WORKER, "theirs", theirs)
    run = pickle.loads(cloudpickle.dumps(_shared.in_worker("mine")(lambda batches: batches)))  # as a worker gets it
    assert list(run([1, 2])) == [1, 2]
    assert mine == {"a": 1} and theirs == {}


def test_words_that_are_met_again_stay_in_the_store(monkeypatch):
    from sparkloom.llm import bpe

    one = bpe.Bpe(bpe.default_tokenizer())
    texts = [f"the common word{i} and\n more{i} tabs\t {i}" for i in range(60)]
    want = one.encode_batch(texts)
    monkeypatch.setattr(bpe, "STORE", 24)
    two, learned = bpe.Bpe(bpe.default_tokenizer()), []
    learn = two.learn
    monkeypatch.setattr(two, "learn", lambda words: learned.extend(words) or learn(words))
    got = []
    for text in texts:
        got += two.encode_batch([text])
        assert sum(map(len, (two.store, two.spaced, *two.older))) <= 48
    assert got == want and learned.count(" common") == 1
