"""Session logs in JSON lines: discovery by bounded heads, and messages streamed from a pinned byte prefix."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidepool.operators.images import nested_images, visible_parts

# Where each client keeps its logs, and how much of a log's head is looked at.
ROOTS = {"codex": ".codex/sessions", "claude": ".claude/projects"}
HEAD_BYTES, HEAD_LINES = 256 * 1024, 32


def log_root(home: str, client: str) -> Path:
    return (Path(home) / ROOTS[client]).resolve()


def checked(path: str | Path, root: Path) -> Path:
    p = Path(path)
    real = p.resolve()
    if p.is_symlink() or not real.is_file() or not (real == root or root in real.parents):
        raise ValueError("a source is a regular file, not a link, in its client's log folder")
    return real


def json_rows(lines: Iterator[bytes]) -> Iterator[tuple[int, dict]]:
    """(line, object) of each line that isn't blank; lines are physical ones."""
    for n, raw in enumerate(lines, 1):
        if not raw.strip():
            continue
        try:
            row = json.loads(raw)
        except ValueError as e:
            raise ValueError(f"line {n} isn't whole JSON; it may still be written") from e
        if not isinstance(row, dict):
            raise ValueError(f"line {n} isn't a JSON object")
        yield n, row


def described(row: dict, client: str) -> dict[str, str]:
    """What one event says of its session: session_id, project, started_at."""
    if client == "claude":
        about, id_ = row, "sessionId"
    else:
        about, id_ = (row.get("payload") if row.get("type") == "session_meta" else {}), "id"
    if not isinstance(about, dict):
        return {}
    found = {"session_id": about.get(id_), "project": about.get("cwd"), "started_at": row.get("timestamp")}
    return {k: v for k, v in found.items() if isinstance(v, str) and v}


def in_project(recorded: str | None, project: str) -> bool:
    if not recorded or not os.path.isabs(recorded):
        return False
    a, b = Path(recorded).resolve(), Path(project).resolve()
    return a == b or b in a.parents


def message_of(row: dict, client: str) -> tuple[str, list[dict]] | None:
    """Role and visible parts of an event, if it's a message to show."""
    if client == "codex":
        item = row.get("payload") if row.get("type") == "response_item" else None
    else:
        item = row.get("message") if row.get("type") in ("user", "assistant") else None
    if not isinstance(item, dict):
        return None
    if client == "codex" and item.get("type") != "message":
        called = "call" in str(item.get("type", ""))
        return "assistant", list(nested_images(item.get("output"))) if called else []
    role = item.get("role", row.get("type"))
    if role not in ("user", "assistant") or item.get("channel") == "analysis":
        return None
    return role, visible_parts(item.get("content"))


def prefix_lines(path: str | Path, length: int, digest=None) -> Iterator[bytes]:  # noqa: ANN001
    """The lines of the first ``length`` bytes, one at a time."""
    with open(path, "rb") as f:
        left = length
        while left:
            raw = f.readline(left)
            if not raw:
                raise ValueError("the source became shorter while it was read")
            left -= len(raw)
            if digest is not None:
                digest.update(raw)
            yield raw


def messages_of(path: str | Path, client: str, length: int, info: dict | None = None, digest=None) -> Iterator[dict]:  # noqa: ANN001
    """number, line, role, images, timestamp, text, parts of each readable message of a prefix, streamed."""
    number = 0
    for line, row in json_rows(prefix_lines(path, length, digest)):
        if info is not None:
            for k, v in described(row, client).items():
                info.setdefault(k, v)
        found = message_of(row, client)
        if found is None:
            continue
        role, parts = found
        text = "\n".join(p["text"] for p in parts if p.get("type") == "text")
        images = sum(p.get("type") != "text" for p in parts)
        if text or images:
            number += 1
            stamp = row.get("timestamp")
            yield {"number": number, "line": line, "role": role, "images": images, "timestamp": stamp if isinstance(stamp, str) else None, "text": text, "parts": parts}


class FilePartition(InputPartition):
    def __init__(self, path: str, client: str):
        super().__init__(path)
        self.path, self.client = path, client


class LogReader(DataSourceReader):
    """Messages of one log, or of several separated by newlines: a partition and a stream each."""

    def __init__(self, options: dict):
        self.paths, self.client = options["path"].split("\n"), options["client"]
        self.length = int(options["sourcebytes"]) if "sourcebytes" in options else None

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p, self.client) for p in self.paths]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        size = os.stat(partition.path).st_size
        length = size if self.length is None else self.length
        if not 0 <= length <= size:
            raise ValueError("the source is shorter than the bytes asked for")
        for m in messages_of(partition.path, partition.client, length):
            yield partition.path, m["number"], m["line"], m["role"], m["images"], m["timestamp"], m["text"], json.dumps(m["parts"], ensure_ascii=False)


class LogSource(DataSource):
    """``spark.read.format("session_log")`` with path, client and, to pin a prefix, sourceBytes."""

    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return "source_file string, number int, line int, role string, images int, timestamp string, text string, parts string"

    def reader(self, schema) -> LogReader:  # noqa: ANN001
        return LogReader({k.lower(): v for k, v in self.options.items()})


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.home, self.clients = options["path"], options["clients"].split(",")

    def partitions(self) -> list[InputPartition]:
        out = []
        for client in self.clients:
            for folder, subs, files in os.walk(log_root(self.home, client), followlinks=False):
                subs[:] = sorted(n for n in subs if not os.path.islink(os.path.join(folder, n)))
                out += [FilePartition(os.path.join(folder, n), client) for n in sorted(files) if n.endswith(".jsonl") and not os.path.islink(os.path.join(folder, n))]
        return out or [FilePartition("", self.clients[0])]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if not partition.path:
            return
        info: dict[str, str] = {}
        stem, modified, error = Path(partition.path).stem, None, None
        try:
            real = checked(partition.path, log_root(self.home, partition.client))
            modified = datetime.fromtimestamp(real.stat().st_mtime).astimezone()
            with open(real, "rb") as f:
                head = f.read(HEAD_BYTES)
            if len(head) == HEAD_BYTES:  # the last line may be cut
                head = head.rpartition(b"\n")[0] or head
            for _, row in json_rows(iter(head.split(b"\n")[:HEAD_LINES])):
                for k, v in described(row, partition.client).items():
                    info.setdefault(k, v)
        except (OSError, ValueError) as e:
            error = str(e)
        yield partition.client, info.get("session_id", stem), info.get("project"), info.get("started_at"), partition.path, modified, error


class HeadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_heads"

    def schema(self) -> str:
        return "client string, session_id string, project string, started_at string, source_file string, file_modified_at timestamp, error string"

    def reader(self, schema) -> HeadReader:  # noqa: ANN001
        return HeadReader({k.lower(): v for k, v in self.options.items()})


def inside(recorded: str, project: str) -> Column:
    """Whether a column of recorded paths lies in a project; each distinct path of a batch is looked at once."""

    @F.pandas_udf("boolean")
    def test(paths: pd.Series) -> pd.Series:
        return paths.map({p: in_project(p, project) for p in paths.unique()})

    return test(recorded)


def discover(spark: SparkSession, home: str, project: str, clients: tuple[str, ...] = ("codex", "claude")) -> tuple[DataFrame, DataFrame]:
    """Sessions of a project, latest file first, and warnings (source_file, message); heads alone are read."""
    spark.dataSource.register(HeadSource)
    heads = spark.read.format("session_heads").option("path", home).option("clients", ",".join(clients)).load()
    sessions = heads.filter(F.col("error").isNull() & F.col("project").isNotNull()).filter(inside("project", project)).drop("error")
    unknown = F.coalesce("error", F.when(F.col("project").isNull(), F.lit("its head names no project")))
    return sessions.orderBy(F.col("file_modified_at").desc(), F.col("source_file").desc()), heads.select("source_file", unknown.alias("message")).filter("message is not null")


def read_log(spark: SparkSession, path: str, client: str, source_bytes: int | None = None) -> DataFrame:
    spark.dataSource.register(LogSource)
    reader = spark.read.format("session_log").option("path", path).option("client", client)
    return (reader if source_bytes is None else reader.option("sourceBytes", source_bytes)).load()


def snapshot(path: str, client: str, home: str, project: str, source_bytes: int | None = None) -> dict:
    """What a prefix of a log is: session, version (digest), source_bytes, source_grew, total_messages. Streamed, then read once more."""
    real = checked(path, log_root(home, client))
    size = real.stat().st_size
    length = size if source_bytes is None else source_bytes
    if not 0 <= length <= size:
        raise ValueError("the source is shorter than the bytes asked for")
    info: dict[str, str] = {}
    digest = hashlib.sha256()
    total = sum(1 for _ in messages_of(real, client, length, info, digest))
    again = hashlib.sha256()
    for _ in prefix_lines(real, length, again):
        pass
    if again.digest() != digest.digest():
        raise ValueError("the source changed while it was read")
    if not in_project(info.get("project"), project):
        raise ValueError("the session records no project, or another one")
    return {"session_id": info.get("session_id", real.stem), "project": info["project"], "started_at": info.get("started_at"), "client": client, "source_file": str(real), "version": digest.hexdigest(), "source_bytes": length, "source_grew": real.stat().st_size > length, "total_messages": total}
