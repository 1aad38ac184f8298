"""Tables that are merged by key: a merge rewrites the buckets that it touches, and one file commits it.

A table is a folder. files/<write>/bucket=<n> hold its rows, dealt by a hash of
their key; versions/<n>.json says which folder each bucket is read from. A merge
reads the buckets that its batch has keys of, writes them anew under a name of
its own, and then writes the next version, which appears whole, by a rename. Until
then, and if it never comes so far, readers see the version before. Two writers
that began with one version can't both commit: the second is refused, and may try
again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table, and rows of a file.
BUCKETS, FILE_ROWS = 64, 1_000_000


class Conflict(RuntimeError):
    """Another writer has committed since."""


@dataclass
class Version:
    number: int
    keys: list[str]
    buckets: int
    schema: T.StructType
    folders: dict[int, str]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, store = self._at(folder)
        return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and not n.startswith((".", "_"))]

    def version(self, number: int | None = None) -> Version:
        """The latest version, or one of that number."""
        number = self.versions()[-1] if number is None else number
        text = self.spark.read.text(f"{self.path}/versions/{number:09d}.json", wholetext=True).first()[0]
        x = json.loads(text)
        return Version(number, x["keys"], x["buckets"], T.StructType.fromJson(x["schema"]), {int(k): v for k, v in x["folders"].items()})

    def read(self, number: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows, of some buckets only if they are given."""
        v = self.version(number)
        paths = [f"{self.path}/{folder}" for n, folder in sorted(v.folders.items()) if buckets is None or n in buckets]
        return self.spark.read.schema(v.schema).parquet(*paths) if paths else self.spark.createDataFrame([], v.schema)

    def _bucketed(self, df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    def _write(self, df: DataFrame, keys: Sequence[str], buckets: int) -> dict[int, str]:
        name = f"files/{uuid.uuid4().hex}"
        rows = self._bucketed(df, keys, buckets).repartition("bucket")
        rows.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(f"{self.path}/{name}")
        return {int(x.split("=")[1]): f"{name}/{x}" for x in self._names(name) if x.startswith("bucket=")}

    def _commit(self, v: Version) -> None:
        final, store = self._at(f"versions/{v.number:09d}.json")
        begun, _ = self._at(f"versions/_{uuid.uuid4().hex}")
        out = store.create(begun, False)
        out.write(bytearray(json.dumps({"keys": v.keys, "buckets": v.buckets, "schema": v.schema.jsonValue(), "folders": v.folders}).encode()))
        out.close()
        if store.exists(final) or not store.rename(begun, final):
            store.delete(begun, False)
            raise Conflict(f"version {v.number} is there already")

    def create(self, df: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> None:
        """The first version: df, whose keys are distinct. Refused where there is one."""
        if self.versions():
            raise Conflict("the table is there already")
        self._commit(Version(1, list(keys), buckets, df.schema, self._write(df, keys, buckets)))

    def merge(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the rows of the buckets that batch has keys of by how(rows, batch), and returns these buckets; rows keep the table's columns.

        how must give no keys that neither rows nor batch have. A batch without
        rows changes nothing.
        """
        v = self.version()
        touched = sorted(r["bucket"] for r in self._bucketed(batch, v.keys, v.buckets).select("bucket").distinct().collect())  # numbers below v.buckets
        if not touched:
            return []
        made = how(self.read(v.number, touched), batch).select(*(F.col(f.name).cast(f.dataType) for f in v.schema))
        new = self._write(made, v.keys, v.buckets)
        kept = {n: folder for n, folder in v.folders.items() if n not in touched}
        self._commit(Version(v.number + 1, v.keys, v.buckets, v.schema, kept | new))
        return touched

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last keep versions and the files that these don't read, and returns how many writes are gone. Not to be run beside a merge."""
        numbers = self.versions()
        used = {folder.split("/")[1] for n in numbers[-keep:] for folder in self.version(n).folders.values()}
        for n in numbers[:-keep]:
            at, store = self._at(f"versions/{n:09d}.json")
            store.delete(at, False)
        gone = [x for x in self._names("files") if x not in used]
        for x in gone:
            at, store = self._at(f"files/{x}")
            store.delete(at, True)
        return len(gone)
