"""Session logs as a data source: JSON lines in files named by the time range that they cover.

``register(spark)`` adds the format ``session_logs``. A file is called
``<first>-<last>.jsonl``, both in whole seconds; its lines are objects with at,
sid, role and content. A batch read makes a task of each file; a comparison of
``at`` with a constant is pushed to the reader, which leaves out files beyond it
without opening them. A stream's offset is the greatest last second that it has
read up to: the cursor of a harvest.

Files are opened with pyarrow, on any file system that it knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "at long, sid string, role string, content string"
_NAME = re.compile(r"(\d+)-(\d+)\.jsonl$")


@dataclass
class LogFile(InputPartition):
    path: str
    first: int
    last: int


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))


def files(folder: str) -> list[LogFile]:
    """The files of a folder by time; others are no logs."""
    fs, path = _open(folder)
    found = [(m, f.path) for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.is_file and (m := _NAME.search(f.path))]
    return sorted((LogFile(p, int(m[1]), int(m[2])) for m, p in found), key=lambda f: (f.first, f.last, f.path))


def lines(folder: str, file: LogFile, low: int | None = None, high: int | None = None) -> Iterator[tuple]:
    """Rows of one file with ``low`` < at <= ``high``; lines that are no such object are skipped."""
    fs, _ = _open(folder)
    with fs.open_input_stream(file.path) as stream:
        rest = b""
        while chunk := stream.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            yield from _rows(whole, low, high)
        yield from _rows([rest], low, high)


def _rows(found: list[bytes], low: int | None, high: int | None) -> Iterator[tuple]:
    for line in found:
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict) and isinstance(row.get("at"), int) and (low is None or row["at"] > low) and (high is None or row["at"] <= high):
            yield row["at"], row.get("sid"), row.get("role"), row.get("content")


class _Batch(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.low, self.high = folder, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            yield f  # Spark looks at the rows again: what is pushed leaves out files
            if getattr(f, "attribute", None) != ("at",) or not isinstance(getattr(f, "value", None), int):
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = f.value if isinstance(f, GreaterThan) else f.value - 1
                self.low = low if self.low is None else max(self.low, low)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                high = f.value - 1 if isinstance(f, LessThan) else f.value
                self.high = high if self.high is None else min(self.high, high)

    def partitions(self) -> list[LogFile]:
        return [f for f in files(self.folder) if (self.low is None or f.last > self.low) and (self.high is None or f.first <= self.high)]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return lines(self.folder, partition, self.low, self.high)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, since: int) -> None:
        self.folder, self.since = folder, since

    def initialOffset(self) -> dict:
        return {"at": self.since}

    def latestOffset(self) -> dict:
        return {"at": max((f.last for f in files(self.folder)), default=self.since)}

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        # a file counts in the batch that its last second falls into, so that none is read by half
        return [f for f in files(self.folder) if start["at"] < f.last <= end["at"]]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return lines(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class SessionLogs(DataSource):
    """``spark.read.format("session_logs").load(folder)``; option ``since`` for streams: the second after which they begin."""

    @classmethod
    def name(cls) -> str:
        return "session_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("since", 0)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SessionLogs)
