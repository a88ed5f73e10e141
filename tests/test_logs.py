"""Logs cut in byte ranges against one stream over each file: numbers, lines, borders within characters and line ends."""

import json
import os
import random

import pytest

from tidepool.sources import logs
from tidepool.sources.sessions import messages_of


def random_events(client, n, seed):
    r = random.Random(seed)
    text = lambda: r.choice(["", "a", "é🙂" * r.randint(1, 40), "two\nlines", " \t", "x" * 300])

    def part():
        return r.choice([
            {"type": r.choice(["text", "input_text", "output_text"]), "text": text()}, {"type": "text", "text": 5}, {"type": "text"}, {"type": "image", "source": {}}, {"type": "thinking", "text": "no"}, "odd", 7, None,
            {"type": "tool_result", "content": [{"type": "image"}, {"type": "x", "content": json.dumps([{"type": "input_image"}])}, {"type": "reasoning", "content": [{"type": "image"}]}]}, {"type": "tool_result", "content": text()},
        ])

    content = lambda: r.choice([text(), [part() for _ in range(r.randint(0, 4))], None, 3, {}])
    more = lambda: r.choice([{}, {}, {"channel": "analysis"}, {"channel": "final"}, {"role": r.choice(["user", "assistant", "system", None, 4])}])
    stamp = lambda: r.choice([{}, {"timestamp": "2026-01-02T03:04:05Z"}, {"timestamp": 5}])
    for _ in range(n):
        if client == "claude":
            yield {"type": r.choice(["user", "assistant", "system", "summary", None]), "message": r.choice([{"content": content(), **more()}, {"content": content(), **more()}, "odd", None]), **stamp()}
        else:
            item = r.choice([{"type": "message", "role": r.choice(["user", "assistant", "developer"]), "content": content(), **more()}, {"type": "function_call_output", "output": r.choice([text(), [{"type": "image"}], json.dumps({"result": [{"type": "image_url"}]})])}, {"type": "reasoning", "content": content()}, {"content": content()}, "odd"])
            yield {"type": r.choice(["response_item", "response_item", "session_meta"]), "payload": item, **stamp()}


def written(path, rows, ends, seed, last=True):
    r = random.Random(seed)
    with open(path, "wb") as f:
        for i, row in enumerate(rows):
            f.write(json.dumps(row, ensure_ascii=r.random() < 0.3).encode() + (r.choice(ends) if last or i < len(rows) - 1 else b""))
            if r.random() < 0.2:
                f.write(r.choice([b"\n", b"  \r\n", b"\t\n"]))


COLUMNS = ("number", "line", "role", "images", "timestamp", "text")


@pytest.fixture
def cut(spark):
    """Set how many bytes a range has."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}

    def to(size, pieces):
        spark.conf.set(names[0], str(max(1, size // pieces)))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield to
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("client", ["claude", "codex"])
@pytest.mark.parametrize("pieces", [1, 2, 7, 64])
def test_ranges_are_numbered_like_a_stream(spark, tmp_path, cut, client, pieces):
    paths = []
    for k, (ends, last) in enumerate([([b"\n"], True), ([b"\r\n", b"\n"], False)]):
        path = str(tmp_path / f"{k}.jsonl")
        written(path, list(random_events(client, 900, k)), ends, k, last)
        paths.append(path)
    cut(os.path.getsize(paths[0]), pieces)
    assert logs.log_lines(spark, paths).select("file", "range").distinct().count() >= 2 * min(pieces, 40)
    rows = logs.log_messages(spark, paths, client).collect()
    for path in paths:
        want = [tuple(m[c] for c in COLUMNS) for m in messages_of(path, client, os.path.getsize(path))]
        assert sorted((tuple(x[c] for c in COLUMNS) for x in rows if x["log"].endswith(path)), key=lambda x: x[0]) == want and len(want) > 20


def test_a_rotated_log_is_one(spark, tmp_path, cut):
    rows = [{"type": "user", "message": {"content": f"m{i}" if i % 3 else ""}} for i in range(300)]
    for k in range(12):
        written(str(tmp_path / f"part-{k}.jsonl"), rows[k * 25 : k * 25 + 25], [b"\n"], k)
    cut(800, 1)
    got = sorted((r["number"], r["text"]) for r in logs.log_messages(spark, str(tmp_path), "claude", rotated=True).collect())
    assert got == list(enumerate([r["message"]["content"] for r in rows if r["message"]["content"]], 1))


@pytest.mark.parametrize("line,said", [('{"type": "us', "whole JSON"), ("[1]", "JSON object"), ("5", "JSON object")])
def test_broken_lines(spark, tmp_path, line, said):
    (tmp_path / "x.jsonl").write_text('{"type": "user", "message": {"content": "a"}}\n' + line)
    found = logs.events(logs.log_lines(spark, str(tmp_path / "x.jsonl")), "claude")
    assert [said in r["problem"] for r in found.filter("problem is not null").collect()] == [True]
    with pytest.raises(Exception, match=said):
        logs.log_messages(spark, str(tmp_path / "x.jsonl"), "claude").collect()


def test_no_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("")
    assert logs.log_messages(spark, str(tmp_path / "x.jsonl"), "codex").count() == 0


def test_texts_are_shuffled_once(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"type": "user", "message": {"content": "a"}}\n')
    plan = logs.log_messages(spark, str(tmp_path / "x.jsonl"), "claude")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2 and "Generate" not in plan
