"""Logs that grow as a stream: a Python data source whose offset is how far each file has been read, in whole lines.

The folder is one that all machines have mounted, as clients write their logs to local files. What a run has read is kept by the
stream's checkpoint, so a run takes the lines that came since, also of files that are new; a last line without its end is
held back until it has one. Long stretches are cut in ranges, which executors read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads, but for the end of its last line; bytes that are looked at together for the last line's end.
RANGE_BYTES, LOOK_BYTES = 32 << 20, 1 << 16


class Stretch(InputPartition):
    """Lines that begin in [begin, end) of a file; ``whole``: a line begins at ``begin`` itself."""

    def __init__(self, path: str, begin: int, end: int, whole: bool):
        super().__init__(path)
        self.path, self.begin, self.end, self.whole = path, begin, end, whole


def whole_lines(path: str, known: int = 0) -> int:
    """Where the last whole line of a file ends; not before ``known``, up to where it was read already."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        if end < known:
            raise ValueError(f"{path} became shorter than what was read of it; a log only grows")
        while end > known:
            begin = max(known, end - LOOK_BYTES)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return known


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"].removeprefix("file:"), options.get("suffix", ".jsonl")
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for folder, subs, files in os.walk(self.folder):
            subs[:] = sorted(s for s in subs if not os.path.islink(os.path.join(folder, s)))
            for path in (os.path.join(folder, n) for n in sorted(files) if n.endswith(self.suffix)):
                if not os.path.islink(path):
                    self.known[path] = whole_lines(path, self.known.get(path, 0))
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = {k: max(v, self.known.get(k, 0)) for k, v in end.items()}
        return [Stretch(p, at, min(at + self.range, until), at == start.get(p, 0)) for p, until in end.items() for at in range(start.get(p, 0), until, self.range)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            if not partition.whole:
                f.seek(partition.begin - 1)
                f.readline()  # the line before: its range reads it
            else:
                f.seek(partition.begin)
            while (at := f.tell()) < partition.end:
                yield partition.path, at, f.readline().rstrip(b"\n").decode(errors="replace")

    def commit(self, end: dict) -> None:
        pass


class LogStreamSource(DataSource):
    """``spark.readStream.format("session_log_stream").option("path", folder)``; options suffix, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "session_log_stream"

    def schema(self) -> str:
        return "log string, at long, value string"

    def streamReader(self, schema) -> LogStreamReader:  # noqa: ANN001
        return LogStreamReader({k.lower(): v for k, v in self.options.items()})


def stream_logs(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """log, at (the byte where a line begins) and value of the lines of a folder's logs, as they come; ``logs.events`` takes them apart."""
    spark.dataSource.register(LogStreamSource)
    reader = spark.readStream.format("session_log_stream").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
