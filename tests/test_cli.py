"""The command line: JSON on standard output, errors on standard error, exit codes."""

import hashlib
import json

import pytest

from tidepool.__main__ import main
from tidepool.operators import provider as P
from tidepool.plans import search as S


def test_search_and_evaluate(spark, tmp_path, capsys):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "a.md").write_text("# Locks\nsqlite busy timeout\n")
    assert main(["search", "--vault", str(vault), "sqlite"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert [r["path"] for r in out["results"]] == ["a.md"] and out["results"][0]["snippets"][0]["start_line"] == 1
    fixture = tmp_path / "cases.json"
    fixture.write_text(json.dumps({"cases": [{"query": "sqlite", "expected_paths": ["missing.md"]}]}))
    assert main(["evaluate", "--vault", str(vault), "--fixture", str(fixture)]) == 2
    assert main(["search", "--vault", str(vault), " "]) == 1
    assert "nonempty" in capsys.readouterr().err
    assert main(["search", "--vault", str(tmp_path / "none"), "x"]) in (1,)


def fixture():
    """Seven notes and eight cases: a scope, an identifier with module and path, superseded wording, another project, global advice, two articles, an empty folder."""
    lesson = lambda path, title, body, **meta: {"path": path, "metadata": {"type": "lesson", "project": "tide", "status": "active", "title": title} | meta, "body": body}
    notes = [
        lesson("lessons/queue.md", "Queue writers", "Let writers wait for the sqlite lock with busy_timeout.", module="db", path_globs=["src/db/**"]),
        lesson("lessons/old-queue.md", "Old queue advice", "Poll the ledger file until it frees up.", status="superseded", superseded_by="[[lessons/queue]]"),
        lesson("lessons/kelp.md", "Kelp deploys", "Warm the harbour cache before a deploy.", project="kelp"),
        lesson("lessons/draft.md", "Draft", "Unfinished thoughts about sqlite lock retries.", status="draft"),
        lesson("lessons/names.md", "Names", "Name branches after their ticket.", project="global"),
        {"path": "articles/moss.md", "metadata": {"type": "article", "title": "Moss"}, "body": "Moss grows on shaded bark and holds rain water."},
        {"path": "articles/tides.md", "metadata": {"type": "article", "title": "Tides"}, "body": "Spring tides follow a new moon."},
    ]
    recall = {"recall": True, "project": "tide"}
    cases = [
        {"query": "writers wait for the lock", "expected_paths": ["lessons/queue.md"], "forbidden_paths": ["lessons/draft.md"], **recall},
        {"query": "busy_timeout", "expected_paths": ["lessons/queue.md"], "module": "db", "path": "src/db/open.py", **recall},
        {"query": "poll the ledger file", "expected_paths": ["lessons/queue.md"], "forbidden_paths": ["lessons/old-queue.md"], **recall},
        {"query": "warm the harbour cache", "expected_paths": ["lessons/kelp.md"], "recall": True, "project": "kelp"},
        {"query": "name branches", "expected_paths": ["lessons/names.md"], **recall},
        {"query": "shaded bark rain", "expected_paths": ["articles/moss.md"], "kind": "article"},
        {"query": "spring tides moon", "expected_paths": ["articles/tides.md"], "kind": "article"},
        {"query": "sqlite", "folder": "nowhere", "expect_empty": True},
    ]
    return {"synthetic": True, "notes": notes, "cases": cases}


def test_evaluation_harness(spark, tmp_path, capsys):
    at = tmp_path / "fixture.json"
    at.write_text(json.dumps(fixture()))
    assert main(["check", "--fixture", str(at), "--output", str(tmp_path / "out/report.json")]) == 0
    report = json.loads(capsys.readouterr().out)
    assert json.loads((tmp_path / "out/report.json").read_text()) == report
    assert [(r["mode"], r["passed"], r["total"]) for r in report["reports"]] == [("fts", 8, 8), ("semantic", 8, 8), ("hybrid", 8, 8)]
    assert report["fixture_sha256"] == hashlib.sha256(at.read_bytes()).hexdigest() and report["index"]["embedded_chunks"] == 7
    at.write_text(json.dumps(fixture() | {"notes": [{"path": "../x.md", "metadata": {}, "body": ""}]}))
    assert main(["check", "--fixture", str(at)]) == 1


def test_index_and_status(spark, tmp_path, capsys):
    vault, cache = tmp_path / "vault", tmp_path / "cache"
    vault.mkdir()
    (vault / "a.md").write_text("sqlite locks\n")
    for command, want in ((["status"], 0), (["index"], 1), (["index", "--rebuild"], 1), (["status"], 1)):
        assert main([command[0], "--vault", str(vault), "--cache", str(cache), *command[1:]]) == 0
        out = json.loads(capsys.readouterr().out)
        assert (out["coverage"]["fresh_chunks"] if command == ["status"] else out["embedded_chunks"]) == want
    assert len(list(cache.iterdir())) == 1 and len(list(next(cache.iterdir()).glob("profile=*/runs/*"))) == 2
    assert S.cache_path(str(vault), str(cache)) != S.cache_path(str(vault), str(cache), True)
    assert main(["index", "--vault", str(vault), "--cache", str(vault / "x")]) == 1 and main(["index", "--vault", str(vault)]) == 1


def test_providers(tmp_path, capsys):
    with pytest.raises(ValueError):
        P.choose("other")
    assert isinstance(P.choose("hashing"), P.HashingProvider) and P.choose("service", model="m").model == "m"
    (tmp_path / "from").mkdir()
    (tmp_path / "from/model.onnx").write_bytes(b"weights")
    pins = {"model.onnx": [7, hashlib.sha256(b"weights").hexdigest()]}
    (tmp_path / "from/pins.json").write_text(json.dumps(pins))
    assert main(["models", "--model-folder", str(tmp_path / "to"), "--source", str(tmp_path / "from")]) == 0
    assert json.loads(capsys.readouterr().out) == {"files": {"model.onnx": True}, "ready": True, "bytes": 7}
    assert isinstance(P.choose("model", folder=str(tmp_path / "to")), P.ModelProvider)
    tries = []

    def flaky(name):
        tries.append(name)
        return b"weights" if len(tries) == 3 else b"broken"

    assert P.download_model(str(tmp_path / "new"), P.pinned(str(tmp_path / "to")), flaky)["ready"] and len(tries) == 3
    with pytest.raises(ValueError):
        P.download_model(str(tmp_path / "never"), P.pinned(str(tmp_path / "to")), lambda n: b"broken")


def test_export_of_an_excerpt(tmp_path, capsys):
    home, work, vault = (tmp_path / n for n in ("home", "work", "vault"))
    log = home / ".claude/projects/x/session-a.jsonl"
    for p in (log.parent, work, vault):
        p.mkdir(parents=True)
    row = {"type": "user", "timestamp": "2026-01-02T03:04:05Z", "cwd": str(work), "sessionId": "a", "message": {"role": "user", "content": "one 🙂 two"}}
    log.write_text(json.dumps(row) + "\n")
    size = log.stat().st_size
    log.write_text(log.read_text() + json.dumps(row) + "\n")
    common = ["--home", str(home), "--project", str(work), "--client", "claude", "--source", str(log), "--source-bytes", str(size)]
    assert main(["read", *common]) == 0
    seen = json.loads(capsys.readouterr().out)
    assert seen["total_messages"] == 1 and seen["source_grew"]
    to = ["--vault", str(vault), "--folder", "chats", "--expect-version", seen["version"], "--asset-root", str(work)]
    assert main(["export", *common, *to, "--excerpt-message", "1", "--start", "4", "--end", "7"]) == 0
    saved = json.loads(capsys.readouterr().out)
    assert "🙂 t" in open(saved["path"], encoding="utf-8").read() and saved["selection"]["mode"] == "excerpt"
    for bad in (["--start", "1"], ["--excerpt-message", "2", "--start", "0", "--end", "1"], ["--excerpt-message", "1", "--start", "3", "--end", "3"], ["--messages", "2"]):
        assert main(["export", *common, *to, *bad]) == 1
