"""Command line: search, recall, index, status, evaluate, check, sessions, read, export, style, registry, models; JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys

CLIENTS = ("codex", "claude")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidepool", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    embedding = argparse.ArgumentParser(add_help=False)
    embedding.add_argument("--provider", default="hashing", choices=["hashing", "service", "model"])
    embedding.add_argument("--endpoint")
    embedding.add_argument("--model")
    embedding.add_argument("--model-folder")
    notes = argparse.ArgumentParser(add_help=False, parents=[embedding])
    notes.add_argument("--vault", required=True)
    notes.add_argument("--cache")
    notes.add_argument("--max-bytes", type=int)
    notes.add_argument("--include-attachments", action="store_true")
    for name in ("search", "recall"):
        p = sub.add_parser(name, parents=[notes])
        p.add_argument("--mode", default="fts", choices=["fts", "semantic", "hybrid"])
        p.add_argument("--limit", type=int, default=5)
        p.add_argument("--min-score", type=float)
        for option in ("project", "status", "kind", "module", "path", "folder"):
            p.add_argument(f"--{option}")
        p.add_argument("query", nargs="?", default="-")
    sub.add_parser("index", parents=[notes]).add_argument("--rebuild", action="store_true")
    sub.add_parser("status", parents=[notes])
    p = sub.add_parser("evaluate", parents=[notes])
    p.add_argument("--fixture", required=True)
    p.add_argument("--mode", default="fts", choices=["fts", "semantic", "hybrid"])
    p = sub.add_parser("check", parents=[embedding], help="a fixture's own notes and cases, in all modes")
    p.add_argument("--fixture", required=True)
    p.add_argument("--output")
    for name in ("sessions", "read", "export"):
        p = sub.add_parser(name)
        p.add_argument("--home", required=True)
        p.add_argument("--project", required=True)
        p.add_argument("--client", choices=CLIENTS)
        p.add_argument("--limit", type=int, default=20)
        if name == "sessions":
            continue
        p.add_argument("--source", required=True)
        p.add_argument("--source-bytes", type=int)
        if name == "read":
            p.add_argument("--offset", type=int, default=0)
            continue
        p.add_argument("--vault", required=True)
        p.add_argument("--folder", default="")
        p.add_argument("--expect-version", required=True)
        p.add_argument("--title", default="")
        p.add_argument("--messages")
        p.add_argument("--excerpt-message", type=int)
        p.add_argument("--start", type=int)
        p.add_argument("--end", type=int)
        p.add_argument("--asset-root", action="append", default=[])
    sub.add_parser("style").add_argument("--vault", required=True)
    sub.add_parser("registry")
    p = sub.add_parser("models", help="whether a model folder is whole; with --source, copy what's missing from there")
    p.add_argument("--model-folder", required=True)
    p.add_argument("--source")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        out, code = run(a)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False, default=str))
    return code


def run(a: argparse.Namespace) -> tuple[object, int]:
    from tidepool.operators import provider as P
    from tidepool.plans import vault

    if a.command == "style":
        return vault.install_style(a.vault), 0
    if a.command == "registry":
        return vault.registered(), 0
    if a.command == "models":
        pins = P.pinned(a.model_folder if a.source is None else a.source)
        return (P.ModelProvider(a.model_folder, pins).status() if a.source is None else P.import_model(a.source, a.model_folder, pins)), 0
    if a.command == "export":
        return export(a), 0
    return (sessions if a.command in ("sessions", "read") else notes)(a)


def notes(a: argparse.Namespace) -> tuple[object, int]:
    from pyspark.sql import SparkSession

    from tidepool.operators.index import VectorIndex
    from tidepool.operators.provider import choose
    from tidepool.plans import search

    spark, provider = SparkSession.builder.getOrCreate(), choose(a.provider, a.endpoint, a.model, a.model_folder)
    if a.command == "check":
        report = search.check(spark, a.fixture, provider, a.output)
        return report, 0 if all(r["passed"] == r["total"] for r in report["reports"] if r["mode"] != "fts") else 2
    scan = {"include_attachments": a.include_attachments} | ({"max_bytes": a.max_bytes} if a.max_bytes else {})
    index = VectorIndex(spark, search.cache_path(a.vault, a.cache, a.include_attachments)) if a.cache else None
    if a.command in ("index", "status") and index is None:
        raise ValueError("--cache names the folder for the index")
    if a.command == "index":
        return search.refresh_index(spark, a.vault, provider, index, a.rebuild, **scan), 0
    if a.command == "status":
        return search.status(spark, a.vault, provider, index, **scan), 0
    if a.command == "evaluate":
        with open(a.fixture, encoding="utf-8") as f:
            report = search.evaluate(spark, a.vault, json.load(f)["cases"], provider, index, a.mode, **scan)
        return report, 0 if report["passed"] == report["total"] else 2
    query = sys.stdin.read(16_001) if a.query == "-" else a.query
    if len(query) > 16_000:
        raise ValueError("A query has at most 16000 characters")
    options = {k: getattr(a, k) for k in ("project", "status", "kind", "module", "path", "folder")}
    request = search.Request(query, a.mode, a.limit, a.command == "recall", min_score=a.min_score, **options)
    return search.search(spark, a.vault, request, provider, index, **scan), 0


def sessions(a: argparse.Namespace) -> tuple[object, int]:
    from pyspark.sql import SparkSession

    from tidepool.sources import sessions as logs

    spark = SparkSession.builder.getOrCreate()
    if a.command == "sessions":
        found, warnings = logs.discover(spark, a.home, a.project, (a.client,) if a.client else CLIENTS)
        total = found.count()
        return {"sessions": [r.asDict() for r in found.limit(a.limit).collect()], "total": total, "has_more": total > a.limit, "warnings": [r.asDict() for r in warnings.collect()]}, 0
    data = logs.snapshot(a.source, a.client, a.home, a.project, a.source_bytes)
    page = logs.read_log(spark, data["source_file"], a.client, data["source_bytes"]).filter(f"number > {a.offset} and number <= {a.offset + a.limit}").orderBy("number")
    return data | {"messages": [r.asDict() for r in page.drop("parts").collect()], "has_more": data["total_messages"] > a.offset + a.limit}, 0


def export(a: argparse.Namespace) -> dict:
    from tidepool.plans.export import Export, Selection

    chosen = Selection(a.messages, a.excerpt_message, a.start, a.end)
    return Export(a.source, a.client, a.home, a.project, a.vault, a.folder, a.expect_version, a.source_bytes, chosen, a.title, tuple(a.asset_root)).run()


if __name__ == "__main__":
    sys.exit(main())
