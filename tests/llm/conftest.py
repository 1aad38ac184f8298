import zlib
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DATA = Path("/root/testdata/sf0.001")

ODD = [
    (900_001, None), (900_002, ""), (900_003, " \t\n"), (900_004, "one"), (900_005, "one two three"),
    (900_006, "same row here with some words and 10.0.0.1 in it"), (900_006, "same row here with some words and 10.0.0.1 in it"),
    (None, "no id, write to a.b@example.org or +49 (0) 123 456-7890"), (None, None),
    (900_007, "x" * 5_000), (900_008, "ä€😀   naïve\u0000null ́ 12³ <|endoftext|> don't 'LL  \r\n\t x "),
    (900_009, "word " * 30_000), (900_010, "İstanbul İİ a@b.c İ 4111 1111 1111 1111"),
]


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.fixture(scope="session")
def data(tmp_path_factory):
    """The smallest tables with odd rows, and columns whose names the operators use inside."""
    folder = tmp_path_factory.mktemp("data")
    docs = pq.read_table(DATA / "documents.parquet")
    n = len(ODD)
    odd = pa.table({"doc_id": pa.array([i for i, _ in ODD], pa.int64()), "text": [t for _, t in ODD], "lang": pa.array([None] * n, pa.string()), "source": pa.array([None] * n, pa.string()), "n_chars": pa.array([None] * n, pa.int64())})
    docs = pa.concat_tables([docs.select(odd.column_names).cast(odd.schema), odd])
    for name in ("_row", "k", "h", "node", "component", "label", "score", "_text", "at", "payload", "digest", "turns"):
        docs = docs.append_column(name, pa.array([7] * len(docs)))
    pq.write_table(docs, folder / "documents.parquet")
    for name in ("benchmark", "labels", "pages", "conversations"):
        table = pq.read_table(DATA / f"{name}.parquet")
        pq.write_table(table.append_column("_row", pa.array([7] * len(table))), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def texts(data):
    t = pq.read_table(f"{data}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="session")
def nothing(data, tmp_path_factory):
    """The same tables without rows."""
    folder = tmp_path_factory.mktemp("nothing")
    for name in ("documents", "benchmark", "labels", "pages", "conversations"):
        pq.write_table(pq.read_table(f"{data}/{name}.parquet").slice(0, 0), folder / f"{name}.parquet")
    return str(folder)


def rows(df, *columns):
    """Rows as sorted tuples; nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))
