"""Driver-side files that are replaced as a whole: no reader sees half of one, and nobody's change in between is lost."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def content(path: Path) -> bytes | None:
    """What a file holds; None where there's none."""
    return path.read_bytes() if path.exists() else None


def replaced(path: Path, make: Callable[[bytes | None], bytes | None]) -> bool:
    """Put what ``make`` makes of a file's content in its place; None leaves it alone. ValueError if it changed meanwhile."""
    was = content(path)
    becomes = make(was)
    if becomes is None:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        aside.write_bytes(becomes)
        if content(path) != was:
            raise ValueError(f"{path.name} changed meanwhile; nothing was written, try again")
        os.replace(aside, path)
    finally:
        aside.unlink(missing_ok=True)
    return True


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir); a local one only where that's unset on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tidepool-") + "/new"


def mounted(uri: str) -> str:
    """The path of a file on a folder that all machines have mounted."""
    return uri[len("file:") :].replace("//", "/") if uri.startswith("file:") else uri
