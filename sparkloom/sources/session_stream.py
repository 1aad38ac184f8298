"""Session logs as a stream: whole lines as they are appended, each once.

    register(spark)
    spark.readStream.format("session_logs").option("path", folder).load()

An offset says for each log how many of its bytes have been read, always up to the
end of a line, so that a line that is still being written waits for its rest. The
driver lists files and looks at the ends of those that grew; tasks read the bytes
between two offsets, one task a log. A stream that starts again from its checkpoint
goes on where it was. Offsets grow with the number of logs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import SESSION_FILE

SCHEMA = "session_id string, n long, value string"
#: Bytes that a log has at least, and bytes that are looked at from its end at a time.
LEAST, TAIL = 100, 1 << 16


def store_of(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def end_of_lines(source, low: int, size: int) -> int:
    """Behind the last line end between low and size; low if there is none."""
    high = size
    while high > low:
        start = max(low, high - TAIL)
        at = source.read_at(high - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return low


@dataclass
class Slice(InputPartition):
    path: str
    low: int
    high: int


class SessionReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.read_to: dict[str, int] = {}
        self.sizes: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, base = store_of(self.folder)
        for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            if info.size is None or info.size <= LEAST or not re.search(SESSION_FILE, info.path) or "/subagents/" in info.path or self.sizes.get(info.path) == info.size:
                continue
            with store.open_input_file(info.path) as source:
                self.read_to[info.path] = end_of_lines(source, self.read_to.get(info.path, 0), info.size)
            self.sizes[info.path] = info.size
        return dict(sorted(self.read_to.items()))

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(path, start.get(path, 0), high) for path, high in end.items() if high > start.get(path, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        """session_id, n (the byte that a line starts at, which orders a log's lines), value; empty lines are left out."""
        store, _ = store_of(self.folder)
        session = re.search(r"/([^/]+)\.jsonl$", partition.path)[1]
        with store.open_input_file(partition.path) as source:
            data = source.read_at(partition.high - partition.low, partition.low)
        at = partition.low
        for line in data.split(b"\n"):
            if line:
                yield session, at, line.decode("utf-8", "replace")
            at += len(line) + 1


class SessionLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SessionReader:
        return SessionReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format session_logs known to a session."""
    spark.dataSource.register(SessionLogs)
