"""Quality rules: counts over words and lines, then compression bands.

A text that repeats itself compresses much better than prose of its length and
noise compresses worse, so a document is kept if its zstandard ratio (compressed
by plain bytes) lies in a band that depends on its length, and so do the ratios
of its fixed chunks, but for a small share of them. The rest behind the last full
chunk is a chunk as well, judged by the band of its own length.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

#: From so many bytes on: the lowest and the highest ratio of a document. Small frames carry more overhead.
BANDS = ((0, 0.0, 9.0), (120, 0.32, 1.05), (400, 0.30, 0.90), (1_000, 0.28, 0.80), (3_000, 0.26, 0.72), (10_000, 0.24, 0.68))
CHUNK = 4096
#: The band of a full chunk, and the share of chunks that may lie outside their bands: one of four or more.
CHUNK_BAND, CHUNK_SHARE = (0.28, 0.75), 0.25
LEVEL = 3

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long"


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(bands) if n_bytes >= least)


def compression_verdict(data: bytes, pack, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE) -> tuple[float, int, bool]:
    """The whole ratio, the number of chunks outside their band, and whether the bands let the text pass; an empty one passes."""
    if not data:
        return 1.0, 0, True
    ratio = len(pack(data)) / len(data)
    low, high = band(len(data), bands)
    chunks = [data[i : i + chunk] for i in range(0, len(data), chunk)] if len(data) > chunk else []
    bad = 0
    for c in chunks:
        least, most = chunk_band if len(c) == chunk else band(len(c), bands)
        bad += not least <= len(pack(c)) / len(c) <= most
    return ratio, bad, low <= ratio <= high and bad <= chunk_share * len(chunks)


def _repeat_words(words: list[str]) -> int:
    """Words in 3-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def base_counts(text: str, word=re.compile("[^\x20\x09-\x0d]+"), symbol=re.compile(r"[#*$%&|<>]+")) -> tuple[int, int, int, int, int]:
    words = word.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += word.search(line) is not None
        else:
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(len, symbol.findall(text))), dup, _repeat_words(words)


def quality_rules(documents: DataFrame) -> DataFrame:
    """One row per row of documents with the counts, base_failed, kept, and the compression figures.

    A null text counts as empty: zero words fail the base rules, so it is not
    kept. A null doc_id stays null, repeated rows give repeated rows, an empty
    table no rows; other columns are ignored. Texts are never cut.
    """

    def judge(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n, chars, symbols, dup, rep = base_counts(text)
                failed = n < 50 or 100 * rep > 50 * n
                ratio, bad, good = compression_verdict(text.encode(), pack)
                rows.append((n, chars, symbols, dup, rep, failed, good and not failed, ratio, bad))
            columns = list(zip(*rows)) or [()] * 9
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return documents.select("doc_id", "text").mapInArrow(judge, SCHEMA)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    return quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"))
