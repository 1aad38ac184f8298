"""Byte-level BPE by way of a trie of the distinct words.

The encoding of a word under ranked merges has one last token for each prefix:
the longest vocabulary entry that ends the prefix and may stand after the last
token of what is left. Whether b may follow a is a matter of the two alone (the
merges must turn a's and b's bytes into just a and b). So the distinct words of
a batch go into a trie, a depth-first walk gives each node its last token once,
and words with a common start share that work. The vocabulary is an automaton: its
state after a prefix lists the entries that end there.

Words never cross documents, so documents are encoded where they lie, without a
shuffle; a worker keeps a bounded store of words that it has met.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import KEPT_IN_WORKER, give_back, in_worker

#: How byte-level vocabularies cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in a worker's store of encoded ones, which only saves time. Half of them are those of the latest texts; of the other half, which stood before, what is met again moves over and the rest goes.
STORE = 300_000
#: Pairs of tokens in a worker's store of those that may follow each other; it is emptied beyond.
FOLLOWING = 400_000
#: Words of more characters don't go into the trie.
LONG = 256
#: Words of a trie: sorted ones, so that those with a common start are in one.
TOGETHER = 4_096

#: A space beside other white space, or at either end of a text.
TOUCH = re.compile(r" \s|\s |^ | $|\s\Z| \Z").search

_LOADED: dict[str, "Bpe"] = {}
KEPT_IN_WORKER["bpe"] = _LOADED


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """Vocabulary, merges and the tables for the trie walk."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        ids = {as_bytes(s): i for s, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        bytes_of = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.packed = [struct.pack("<I", i) for i in range(len(self.bytes_of))]
        #: Of a pair of tokens (one number), the rank of its merge; of a token, the pair that it is first made of.
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        made = {}
        for n, pair in enumerate(data["model"]["merges"]):
            x, y = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
            key = ids[x] << 20 | ids[y]
            if key not in self.rank:
                self.rank[key], made[key] = n, ids[x + y]
                self.parts.setdefault(made[key], (ids[x], ids[y]))
        singles = [ids[bytes([b])] for b in range(256)]
        reachable = set(singles) | set(self.parts)
        self._automaton({b: i for b, i in ids.items() if i in reachable and self._merge([singles[x] for x in b], made) == [i]})
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.may_follow: dict[int, bool] = {}
        #: Encodings of words of texts that are cut by the pattern.
        self.store: dict[str, bytes] = {}
        #: Encodings of a space and what stands up to the next one.
        self.spaced: dict[str, bytes] = {}
        #: The stores before these.
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def _merge(self, out: list[int], made: dict[int, int]) -> list[int]:
        """Plain ranked merging, for short strings."""
        while len(out) > 1:
            keys = [x << 20 | y for x, y in zip(out, out[1:])]
            best = min((self.rank[k], i) for i, k in enumerate(keys) if k in self.rank) if not made.keys().isdisjoint(keys) else None
            if best is None:
                break
            out[best[1] : best[1] + 2] = [made[keys[best[1]]]]
        return out

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        """States are the starts of tokens; of each, the tokens that end there (with their lengths), the longest first."""
        self.go: dict[int, int] = {}
        self.back, self.ending = [0], [()]
        level = [(0, t) for t in sorted(tokens)]
        depth = 0
        while level:
            nxt = []
            for state, t in level:
                x = t[depth]
                to = self.go.get(state << 8 | x)
                if to is None:
                    to = len(self.back)
                    self.back.append(self.step(self.back[state], x) if state else 0)
                    self.go[state << 8 | x] = to
                    self.ending.append(self.ending[self.back[to]])
                if len(t) == depth + 1:
                    self.ending[to] = ((tokens[t], depth + 1), *self.ending[to])
                else:
                    nxt.append((to, t))
            level, depth = nxt, depth + 1

    def step(self, state: int, x: int) -> int:
        """The state of the longest start of a token that ends with x, after state."""
        while (to := self.go.get(state << 8 | x)) is None and state:
            state = self.back[state]
        return to or 0

    def _end(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one end of token while it is built, each with the rank of the merge that ends it."""
        out = self.ends.get((token, side))
        if out is None:
            out, until, at = [(token, 1 << 60)], 1 << 60, token
            while at in self.parts:
                x, y = self.parts[at]
                until = self.rank[x << 20 | y]
                at = (x, y)[side]
                out.append((at, until))
            self.ends[token, side] = out
        return out

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves them apart: no merge across the border comes before those that close either side.

        Of equal merges the left one goes first, so the left side needs a lower rank to be taken, the right side none that is higher.
        """
        if len(self.may_follow) > FOLLOWING:
            self.may_follow.clear()
        known, rank, left = True, self.rank, self._end(b, 0)
        for x, x_until in self._end(a, 1):
            for y, y_until in left:
                n = rank.get(x << 20 | y)
                if n is not None and n < x_until and n <= y_until:
                    known = False
        self.may_follow[a << 20 | b] = known
        return known

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encodings of words, by walks over their tries. Long ones are paths of their own, which need no nodes."""
        out = {word: self.walk(word.encode()) for word in words if len(word) > LONG}
        ordered = sorted(word for word in words if len(word) <= LONG)
        for at in range(0, len(ordered), TOGETHER):
            self._learn(ordered[at : at + TOGETHER], out)
        return out

    def _learn(self, words: list[str], out: dict[str, bytes]) -> None:
        trie: dict = {}
        for word in words:
            node = trie
            for x in word.encode():
                nxt = node.get(x)
                if nxt is None:
                    nxt = node[x] = {}
                node = nxt
            node[-1] = word
        # of the prefix of each length on the path: its last token and its encoding
        last, coded = [0] * (4 * LONG + 1), [b""] * (4 * LONG + 1)
        go, step, ending, known, follows, packed = self.go.get, self.step, self.ending, self.may_follow.get, self.follows, self.packed
        stack = [(1, x, child, 0) for x, child in trie.items()]
        push, pop = stack.append, stack.pop
        while stack:
            end, x, node, state = pop()
            state = go(state << 8 | x) or step(state, x)
            for token, size in ending[state]:
                before = last[end - size]
                if end == size:
                    break
                fits = known(before << 20 | token)
                if follows(before, token) if fits is None else fits:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last[end] = token
            coded[end] = code = coded[end - size] + packed[token]
            for y, child in node.items():
                if y < 0:
                    out[child] = code
                else:
                    push((end + 1, y, child, state))

    def walk(self, data: bytes) -> bytes:
        """The encoding of one long word."""
        last, sizes, state = [0], [0], 0
        for end, x in enumerate(data, 1):
            state = self.step(state, x)
            for token, size in self.ending[state]:
                before = last[end - size]
                if end == size:
                    break
                fits = self.may_follow.get(before << 20 | token)
                if self.follows(before, token) if fits is None else fits:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            sizes.append(size)
        at, out = len(data), array("I")
        while at:
            out.append(last[at])
            at -= sizes[at]
        out.reverse()
        return out.tobytes()

    def pieces(self, text: str) -> list:
        """Words as strings, special tokens as their bytes."""
        if not self.cut or not any(s in text for s in self.special):
            return self.words(text)
        out: list = []
        for n, part in enumerate(self.cut(text)):
            out += [array("I", [self.special[part]]).tobytes()] if n % 2 else self.words(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers.

        Where no other white space touches a space, text can be cut before each
        space, and what follows is looked up whole; other texts are cut by the pattern.
        """
        if len(self.store) + len(self.spaced) > STORE // 2:
            self.older, self.store, self.spaced = (self.store, self.spaced), {}, {}
        store, spaced = self.store, self.spaced
        plain = [not TOUCH(t) and not any(s in t for s in self.special) for t in texts]
        cut = [t.split(" ") if p else self.pieces(t) for t, p in zip(texts, plain)]
        heads = [self.words(words[0]) if p else () for words, p in zip(cut, plain)]
        unseen = set().union(*(words for words, p in zip(cut, plain) if p)).difference(spaced)
        kept = {w for words, p in zip(cut, plain) if not p for w in words if type(w) is str}.union(*heads).difference(store)
        for words, now, older in zip((kept, unseen), (store, spaced), self.older):
            again = {w: older[w] for w in words if w in older}
            words.difference_update(again)
            now.update(again)
        unseen = {w: self.words(" " + w) for w in unseen}
        new = kept.union(*unseen.values())
        if new:
            found = self.learn(new)
            for w in kept:
                store[w] = found[w]
            for w, words in unseen.items():
                spaced[w] = found[words[0]] if len(words) == 1 else b"".join([found[x] for x in words])
        out = []
        for words, p, head in zip(cut, plain, heads):
            if p:
                parts = list(map(spaced.__getitem__, words))
                parts[0] = b"".join([store[x] for x in head])
            else:
                parts = [store[w] if type(w) is str else w for w in words]
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
        give_back()
    return _LOADED[path]


def encode_decode(documents: DataFrame, tokenizer: str, keep: bool = True) -> DataFrame:
    """One row per row of documents: doc_id, n_tokens, ids_sha256, decoded_sha256, and, if keep, ids (binary, 4 bytes a token) and decoded.

    tokenizer is a tokenizers JSON file that every executor can open. A null
    text counts as empty and has no tokens; a null doc_id stays null, repeated
    rows give repeated rows, an empty table no rows, and other columns are
    ignored. Texts of any length are encoded whole, some at a time.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")
    names = [x.split()[0] for x in schema.split(", ")]

    @in_worker("bpe")
    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                gc.disable()  # a trie is many small dicts without cycles
                try:
                    ids = bpe.encode_batch([t or "" for t in part.column(1).to_pylist()])
                finally:
                    gc.enable()
                decoded = [bpe.decode(x) for x in ids]
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())] if keep else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from ._shared import table

    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer or default_tokenizer(), keep=False)
