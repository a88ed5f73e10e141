"""Session logs: discovery, messages, selections, images, export. Logs of both kinds are built here."""

import base64
import json
import multiprocessing

import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as X
from tidepool.operators import images, messages
from tidepool.plans import vault as V
from tidepool.plans.export import Export, Selection, render_message, split_context
from tidepool.sources import sessions as L

PIXEL = base64.b64encode(b"\x89PNG fake").decode()
TEXTS = ["first question", "SECRET canary", "  spaced\r\n```\n![x](no.png)\n``` 🙂 ", "again again end"]


def log(home, project, client="codex", name="one", more=()):
    if client == "codex":
        p = home / ".codex/sessions/2026/01/02" / f"rollout-{name}.jsonl"
        rows = [{"type": "session_meta", "timestamp": "2026-01-02T03:04:05Z", "payload": {"id": name, "cwd": str(project)}}]
        rows += [{"type": "response_item", "timestamp": f"2026-01-0{2 + i // 2}T03:04:05Z", "payload": {"type": "message", "role": "user" if i % 2 == 0 else "assistant", "content": [{"type": "input_text", "text": t}]}} for i, t in enumerate(TEXTS)]
        rows += [{"type": "response_item", "payload": {"type": "reasoning", "content": "hidden"}}, {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": "hidden"}}, {"type": "response_item", "payload": {"type": "message", "role": "assistant", "channel": "analysis", "content": "hidden"}}]
    else:
        p = home / ".claude/projects/x" / f"session-{name}.jsonl"
        rows = [{"type": "user" if i % 2 == 0 else "assistant", "timestamp": f"2026-01-0{2 + i // 2}T03:04:05Z", "cwd": str(project), "sessionId": name, "message": {"role": "user" if i % 2 == 0 else "assistant", "content": t}} for i, t in enumerate(TEXTS)]
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n\n".join(json.dumps(r) for r in [*rows, *more]) + "\n", encoding="utf-8")
    return p


@pytest.fixture
def place(tmp_path):
    for n in ("home", "work", "work-other", "vault"):
        (tmp_path / n).mkdir()
    return tmp_path


def export(place, source, client, **more):
    data = L.snapshot(source, client, str(place / "home"), str(place / "work"))
    return Export(str(source), client, str(place / "home"), str(place / "work"), str(place / "vault"), "chats", data["version"], **more)


@pytest.mark.parametrize("client", ["codex", "claude"])
def test_messages(spark, place, client):
    p = log(place / "home", place / "work", client)
    rows = L.read_log(spark, str(p), client).orderBy("number").collect()
    assert [r["text"] for r in rows] == TEXTS and [r["number"] for r in rows] == [1, 2, 3, 4]
    assert [r["role"] for r in rows] == ["user", "assistant"] * 2
    size = p.stat().st_size
    with p.open("a") as f:
        f.write('{"broken')
    assert L.read_log(spark, str(p), client, size).count() == 4
    with pytest.raises(ValueError, match="line"):
        L.snapshot(p, client, str(place / "home"), str(place / "work"))


def test_discovery(spark, place):
    log(place / "home", place / "work", name="a")
    log(place / "home", place / "work", "claude", name="b")
    log(place / "home", place / "work-other", name="c")
    (place / "home/.codex/sessions/bad.jsonl").write_text("[]\n")
    found, warnings = L.discover(spark, str(place / "home"), str(place / "work"))
    assert {r["session_id"] for r in found.collect()} == {"a", "b"}
    assert [r["source_file"].endswith("bad.jsonl") for r in warnings.collect()] == [True]


def test_selection_and_excerpt(spark):
    assert messages.selection_numbers("4,2,2-3", 4) == [2, 3, 4]
    for bad in ("0", "3-2", "a", "5"):
        with pytest.raises(ValueError):
            messages.selection_numbers(bad, 4)
    d = spark.createDataFrame([("中🙂abc",)], "t string")
    assert d.select(messages.excerpt(F.col("t"), 1, 3)).first()[0] == "🙂a"
    assert d.select(messages.excerpt(F.col("t"), 1, 9)).first()[0] is None


def test_context_and_cards_agree_with_columns(spark):
    cases = ["# AGENTS.md instructions for x\n<skill a='b'>one\ntwo</skill> \nask", "plain ``` text", "<environment_context>e</environment_context>", "<other>x</other> y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i")
    got = rows.select(X.context_prefix(F.col("t")).alias("c"), X.message_card(F.lit("user"), F.lit(7).cast("long"), F.lit(""), F.col("t"), "codex").alias("card")).collect()
    for t, r in zip(cases, got, strict=True):
        assert split_context(t)[0] == r["c"]
        assert render_message({"number": 7, "role": "user", "timestamp": None}, t, "codex") == r["card"]


def test_images(tmp_path):
    (tmp_path / "in.png").write_bytes(b"img")
    (tmp_path / "out").mkdir()
    store = images.ImageStore(tmp_path / "assets", "n.assets", tmp_path, tmp_path / "log.jsonl")
    block = {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": PIXEL}}
    text = "a ![x](in.png) `![y](in.png)`\n```\n![z](in.png)\n```\n![far](https://e.x/a b.png) ![gone](../../etc/passwd)"
    out = store.render([{"type": "text", "text": text}, block, block], 3)
    assert out.count("n.assets/") == 3 and "`![y](in.png)`" in out and "![z](in.png)" in out and images.UNAVAILABLE in out
    assert len(list((tmp_path / "assets").iterdir())) == 2
    assert list(images.nested_images({"output": json.dumps([{"type": "thinking", "content": [block]}, {"content": [block]}])})) == [block]
    for bad in ("C:x.png", "C:/x.png", "file://host/x.png", "ftp://x/y.png", "file:///C:/x.png", "file:////h/x"):
        with pytest.raises(ValueError):
            images.local_path(bad, windows=False)
    assert images.local_path("file://localhost/a%20b", windows=False) == "/a b" and images.local_path("C:/x.png", windows=True) == "C:/x.png"
    assert images.local_path("file:///C:/a%20b.png", windows=True) == "C:\\a b.png"
    with pytest.raises(ValueError):
        images.local_path("C:x.png", windows=True)


@pytest.mark.parametrize(("text", "found"), [
    ("![a](x.png)", ["a|x.png"]), ('![a]( <x y.png> "t" ) ![](z)', ["a|x y.png", "|z"]), ("![a](x y)", []), ("![a\nb](x)", []), ("![a](<x)", ["a|x"]),
    ("`![a](x)`", []), ("``![a](x)` ![b](y)``", []), ("` ![a](x)", ["a|x"]), ("```\n![a](x)\n~~~\n```\n![b](y)", ["b|y"]), ("    ```\n![a](x)", ["a|x"]), ("~~~~ x\n~~~\n![a](x)\n~~~~~\n![b](y)", ["b|y"]),
])
def test_image_links(text, found):
    got = []
    images.rewrite(text, lambda ref, alt: got.append(f"{alt}|{ref}") or "")
    assert got == found and images.rewrite(text, lambda ref, alt: "") == text or got


@pytest.mark.parametrize("client", ["codex", "claude"])
def test_export_once(place, client):
    p = log(place / "home", place / "work", client, more=[{"type": "user", "cwd": "x", "message": {"role": "user", "content": [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": PIXEL}}]}}] if client == "claude" else [])
    e = export(place, p, client, title="A: title")
    first, second = e.run(), e.run()
    assert not first["duplicate"] and second["duplicate"] and first["path"] == second["path"]
    note = open(first["path"], encoding="utf-8", newline="").read()
    assert "hidden" not in note and note.count("^message-") == first["saved_messages"] and note.count("\n## ") == 2
    assert first["image_files"] == (client == "claude")
    some = export(place, p, client, selection=Selection("1,3")).run()
    assert "SECRET" not in open(some["path"], encoding="utf-8").read()
    with open(first["path"], "a") as f:
        f.write("edited")
    with pytest.raises(ValueError, match="differs"):
        e.run()
    with pytest.raises(ValueError, match="changed since"):
        Export(str(p), client, str(place / "home"), str(place / "work"), str(place / "vault"), "chats", "0" * 64).run()


def _run(e):
    return e.run()["duplicate"]


def test_concurrent_exports(place):
    e = export(place, log(place / "home", place / "work"), "codex")
    with multiprocessing.get_context("spawn").Pool(3) as pool:
        assert sorted(pool.map(_run, [e] * 3)) == [False, True, True]


def test_filename_and_style(tmp_path):
    assert X.filename_title("a/b: c  d.") == "a-b- c d" and X.filename_title("\0") == "conversation"
    assert len(X.filename_title("长" * 100).encode()) <= 140
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / ".obsidian/appearance.json").write_text('{"theme": "x", "enabledCssSnippets": ["mine"]}')
    V.install_style(str(tmp_path))
    V.install_style(str(tmp_path))
    assert json.loads((tmp_path / ".obsidian/appearance.json").read_text()) == {"theme": "x", "enabledCssSnippets": ["mine", V.STYLE]}
    (tmp_path / "r.json").write_text(json.dumps({"vaults": {"k": {"path": str(tmp_path), "open": True}}}))
    assert V.registered(str(tmp_path / "r.json"))[0]["exists"]
