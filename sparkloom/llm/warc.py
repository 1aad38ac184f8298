"""WARC archives that are read through an index.

Writing: each task streams gzip members, one record a member, into archives of
its own in a shared folder and returns an index row for each record (file,
offset, length, url, digest, ...). An archive starts with a warcinfo record and
ends at a size. Spark commits the index, so that archives of failed attempts are
in no index and are never read.

Reading: index rows are selected first; those of a file are sorted by offset,
neighbours are coalesced into byte ranges of bounded length, and each range is
one read, from which the records are parsed and checked against their digest.
Ranges are dealt over as many tasks as their bytes need.

Which record of equal payloads holds them is found by digests alone; payloads
move once, to the tasks that write.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import join_counted, written

#: Payloads of fewer bytes are always stored.
LEAST = 100
#: Byte ranges are cut at multiples of this, by where a record starts.
RANGE = 4 << 20
#: An archive is closed once it has so many bytes, and a task reads about so many.
ARCHIVE, TASK = 1 << 30, 8 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (never null), digest, record_type, refers_to and its url.

    Of equal payloads of at least 100 bytes the one with the smallest page_id
    is the response. Repeated rows of that page are responses too; rows with a
    null page_id are revisits where another page has the payload.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # one number for the first page, and how many, a digest; most have one, which needs no join
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1 and first is not null"), "first")
    out = join_counted(rows, first, ["digest"], "n", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return out.select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_to_url"),
    )


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def info_bytes(name: str) -> bytes:
    """The record that an archive starts with."""
    block = b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name, 0)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def record_id(name: str, offset: int) -> str:
    """One for each record there is: archives have names of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>"


def record_bytes(record: str, page_id, url: str, payload: bytes, digest: str, record_type: str, refers_to, refers_to_url) -> bytes:
    """One record, not yet compressed. A revisit has no block, only the digest and length of the payload it refers to.

    The page's id, which need not be unique, stands in a field of its own, and
    so does that of the page that a revisit refers to.
    """
    block = payload if record_type == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {len(payload)}", f"Page-ID: {'' if page_id is None else page_id}"]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_clean(refers_to_url)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields and block; raises if it is damaged."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut short")
    if fields["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError("a payload differs from its digest")
    return fields | {"block": block}


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records (see with_record_types) below folder and returns their index, which is written there too.

    A table without rows gives an index without rows. Rows that repeat are
    written again.
    """
    spark = records.sparkSession

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        sink = None

        def member(record: bytes) -> bytes:
            gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            return gz.compress(record) + gz.flush()

        try:
            for batch in batches:
                rows: list[tuple] = []
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    page_id, url, payload, digest, kind, *refers = r
                    if sink is not None and offset >= ARCHIVE:
                        sink.close()
                        sink = None
                    if sink is None:
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(f"{base}/archives", recursive=True)
                        sink = store.open_output_stream(f"{base}/archives/{name}", compression=None)
                        offset += sink.write(member(info_bytes(name)))
                    data = member(record_bytes(record_id(name, offset), page_id, url, payload.encode(), digest, kind, *refers))
                    sink.write(data)
                    rows.append((f"archives/{name}", offset, len(data), url, digest, page_id, kind))
                    offset += len(data)
                columns = list(zip(*rows)) or [()] * 7
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if sink is not None:
                sink.close()

    records.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(selected: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the selected index rows, from coalesced reads in order of offset; with payloads, also payload (null for revisits)."""
    ranges = (
        selected.select("file", F.floor(F.col("offset") / RANGE).alias("block"), F.struct("offset", "length").alias("at"))
        .groupBy("file", "block")
        .agg(F.array_sort(F.collect_list("at")).alias("at"))
        .select("file", F.transform("at", lambda x: x["offset"]).alias("offsets"), F.transform("at", lambda x: x["length"]).alias("lengths"))
    )
    size = selected.agg(F.sum("length")).first()[0] or 0
    ranges = ranges.repartition(max(1, -(-size // TASK)))
    schema = READ + (", payload binary" if payloads else "")

    def read(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for name, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                with store.open_input_file(f"{base}/{name}") as source:
                    start = offsets[0]
                    data = memoryview(source.read_at(offsets[-1] + lengths[-1] - start, start))
                for offset, length in zip(offsets, lengths):
                    x = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                    number = lambda key: int(v) if (v := x.get(key)) else None  # noqa: B023, E731
                    size = len(x["block"]) if x["WARC-Type"] == "response" else int(x["Payload-Length"])
                    digest = x["WARC-Payload-Digest"].removeprefix("sha256:")
                    row = (number("Page-ID"), x["WARC-Target-URI"], x["WARC-Type"], size, digest, number("Refers-To-Page-ID"))
                    rows.append(row + ((x["block"] if x["WARC-Type"] == "response" else None,) if payloads else ()))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in schema.split(", ")])

    return ranges.mapInArrow(read, schema)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages as WARC archives and returns their index. A null html is an empty payload, a null url an empty one; other columns are ignored."""
    return write_archives(with_record_types(pages), folder)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import shared_dir, table

    folder = shared_dir(spark, "warc")
    index = archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
