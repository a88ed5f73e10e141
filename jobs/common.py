"""What the jobs share: their settings from a small JSON file, a command line, a session of their own, a log."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

HERE = os.path.dirname(os.path.abspath(__file__))


def settings(name: str, path: str | None = None) -> dict:
    """The settings of a job: those of its own file beside it, with those of another file over them."""
    with open(f"{HERE}/{name}.json", encoding="utf-8") as f:
        known = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        if odd := sorted(set(given) - set(known)):
            raise ValueError(f"{path} has settings that {name} doesn't know: {', '.join(odd)}")
        known |= given
    return known


def command(name: str, about: str, paths: dict[str, str], work: Callable[..., dict], argv: list[str] | None = None) -> dict:
    """Parse the paths and ``--config``, do the work in a session that ends with it, and print what it reports."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for p, said in paths.items():
        parser.add_argument(p, help=said)
    parser.add_argument("--config", help=f"a JSON file; its settings go over those of jobs/{name}.json")
    given = vars(parser.parse_args(argv))
    options = settings(name, given.pop("config"))
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        report = work(spark, **given, **options)
    finally:
        spark.stop()
    print(json.dumps(report))
    return report


def missing(e: AnalysisException) -> bool:
    """Whether a read failed for want of the folder."""
    return (e.getCondition() or "").startswith(("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))
