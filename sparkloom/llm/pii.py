"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus
signs, dots and digits, URL schemes, and cue words of identifiers. From each
anchor a small deterministic parser goes as far left and right as its grammar
allows and checks what it has. Offsets are code points, ends exclusive.

Kinds, in this order: email, ip, card and phone have the grammars below, taken
leftmost and without overlaps within a kind; url (a scheme and what follows)
and account (a cue word, a mark or two, and an identifier with a digit) come on top.

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), each part at most 255
    card   [0-9]([\\x20-]?[0-9])+, 14 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 10 to 15 digits
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import in_worker

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
CUES = ("account", "acct", "iban", "ssn", "passport", "api_key", "apikey", "api key", "token", "secret", "password", "passwd", "licence no", "license no", "customer id", "user id")

DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
PHONE = frozenset(string.digits + " ().-")
ALNUM = frozenset(string.ascii_letters + string.digits)
ID_PART = ALNUM | {"-", "_"}
MARKS = frozenset(" \t:=#\"'")
URL_END = frozenset(" \t\r\n\x0b\x0c<>\"'`|\\^{}")

_AUTOMATON = None


def automaton():
    """Of all anchors, over lower-cased text; one for each worker."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for kind, words in (("at", ("@",)), ("plus", ("+",)), ("digit", string.digits), ("scheme", SCHEMES), ("cue", CUES)):
            for w in words:
                made.add_word(w, (kind, len(w)))
        made.make_automaton()
        _AUTOMATON = made
    return _AUTOMATON


def _labels(text: str, at: int) -> int:
    """The end of label(.label)+ from at, or at where there is none."""
    n, end, parts, i = len(text), at, 0, at
    while True:
        j = i
        while j < n and text[j] in LABEL:
            j += 1
        if j == i:
            break
        parts, end = parts + 1, j
        if j >= n or text[j] != ".":
            break
        i = j + 1
    return end if parts >= 2 else at


def emails(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    out, free = [], 0
    for at in anchors:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if at >= free and start < at and (end := _labels(text, at + 1)) > at + 1:
            out.append((start, end))
            free = end
    return out


def digit_runs(anchors: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of adjacent digits, from their places."""
    out: list[list[int]] = []
    for i in anchors:
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [(a, b) for a, b in out]


def ips(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, k = [], 0
    while k + 3 < len(runs):
        four = runs[k : k + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(b - a <= 3 or not text[a : b - 3].strip("0") for a, b in four) and all(int(text[max(a, b - 3) : b]) <= 255 for a, b in four):
                out.append((four[0][0], four[3][1]))
            k += 4
        else:
            k += 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, k = [], 0
    while k < len(runs):
        start, end = runs[k]
        size = end - start
        k += 1
        while k < len(runs) and runs[k][0] == end + 1 and text[end] in " -":
            end = runs[k][1]
            size += end - runs[k][0]
            k += 1
        if 14 <= size <= 19 and luhn("".join(c for c in text[start:end] if c in DIGITS)):
            out.append((start, end))
    return out


def phones(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    out, n = [], len(text)
    for at in anchors:
        if at + 1 >= n or text[at + 1] not in DIGITS:
            continue
        end = at + 2
        while end < n and text[end] in PHONE:
            end += 1
        while end > at + 3 and text[end - 1] not in DIGITS:
            end -= 1
        if end > at + 3 and 10 <= sum(c in DIGITS for c in text[at:end]) <= 15:
            out.append((at, end))
    return out


def urls(text: str, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, free, n = [], 0, len(text)
    for start, end in anchors:
        if start < free or start and text[start - 1] in ALNUM:
            continue
        body = end
        while end < n and text[end] not in URL_END:
            end += 1
        while end > body and text[end - 1] in ".,;:!?)]*#%$&":
            end -= 1
        if any(c in ALNUM for c in text[body:end]):
            out.append((start, end))
            free = end
    return out


def accounts(text: str, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, free, n = [], 0, len(text)
    for start, end in anchors:
        if start < free or start and text[start - 1] in ID_PART:
            continue
        at = end
        while at < n and at < end + 8 and text[at] in MARKS:
            at += 1
        if at == end:
            continue
        stop = at
        while stop < n and text[stop] in ID_PART:
            stop += 1
        found = text[at:stop]
        if len(found) >= 6 and any(c in DIGITS for c in found):
            out.append((at, stop))
            free = stop
    return out


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by start, then kind."""
    at: dict[str, list] = {"at": [], "plus": [], "digit": [], "scheme": [], "cue": []}
    lower = text.lower()
    if len(lower) != len(text):  # a few letters have longer lower cases, which would move the offsets
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for last, (kind, size) in automaton().iter(lower):
        at[kind].append((last - size + 1, last + 1) if kind in ("scheme", "cue") else last)
    runs = digit_runs(at["digit"])
    found = {
        "email": emails(text, at["at"]),
        "ip": ips(text, runs),
        "card": cards(text, runs),
        "phone": phones(text, at["plus"]),
        "url": urls(text, sorted(at["scheme"])),
        "account": accounts(text, sorted(at["cue"], key=lambda x: (x[0], -x[1]))),
    }
    return [(k, a, b) for a, _, k, b in sorted((a, n, k, b) for n, k in enumerate(KINDS) for a, b in found[k])]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch that spans cover becomes the name of its first kind in brackets; overlapping spans are one stretch."""
    out, upto = [], 0
    cover: list[list] = []
    for kind, a, b in spans:
        if cover and a < cover[-1][2]:
            cover[-1][2] = max(cover[-1][2], b)
        else:
            cover.append([kind, a, b])
    for kind, a, b in cover:
        out += [text[upto:a], f"[{kind.upper()}]"]
        upto = b
    return "".join([*out, text[upto:]])


FIELDS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted")


def find_pii(documents: DataFrame, *keep: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of documents: the columns keep, then the fields asked for.

    A null text counts as empty and has no spans; null ids stay null, repeated
    rows give repeated rows, an empty table no rows; columns that aren't named
    are ignored. Texts are searched whole.
    """
    rows = documents.select("text", *keep)
    types = {"base_sha256": "string", "spans": "string", "redacted": "string"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), *(f"{f} {types.get(f, 'long')}" for f in fields)])
    names = [*keep, *fields]

    @in_worker("pii")
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f: [] for f in fields}
            for text in batch.column(0).to_pylist():
                text = text or ""
                spans = find_spans(text)
                base = [s for s in spans if s[0] in BASE]
                made = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE}
                made["spans"] = joined(spans)
                if "base_sha256" in out:
                    made["base_sha256"] = hashlib.sha256(joined(base).encode()).hexdigest()
                if "redacted" in out:
                    made["redacted"] = redact(text, spans) if spans else text
                for f in fields:
                    out[f].append(made[f])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(v, pa.string() if f in types else pa.int64()) for f, v in out.items())], names=names)

    return rows.mapInArrow(run, schema)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    return find_pii(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", fields=FIELDS[:-1])
