"""The archive job over input that grows: new files only, numbers that go on, rows aside, a batch that is run again."""

import json
import shutil

import pytest

from jobs import common, session_archive
from tidepool.operators import messages

OPTIONS = {"client": "claude", "shelves": 3, "span": 4, "collapse_context": True, "files_per_batch": 100}


def put(spark, folder, rows):
    spark.createDataFrame(rows, session_archive.TURNS).coalesce(1).write.mode("append").parquet(folder)


def numbers(spark, target):
    t = session_archive.table(spark, f"{target}/messages", session_archive.MESSAGES)
    return sorted(((r["conv_id"], r["turn"], r["number"], r["role"]) for r in t.collect()))


@pytest.fixture
def places(tmp_path):
    return {"source": str(tmp_path / "in"), "target": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}


FIRST = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", ""), (1, 3, "assistant", "b\nc"), (1, 9, "user", "d"), (2, 0, "user", None), (2, 1, "user", "e"), (None, 1, "user", "lost"), (3, None, "user", "lost too"), (4, 0, None, "no role")]
SECOND = [(1, 9, "user", "again"), (1, 10, "assistant", "f"), (1, 11, "user", "g"), (2, 0, "user", "late"), (2, 30, "assistant", "h"), (5, 0, "user", "i"), (4, 1, "user", "j")]
AFTER_FIRST = [(1, 1, 1, "user"), (1, 3, 2, "assistant"), (1, 9, 3, "user"), (2, 1, 1, "user")]
AFTER_SECOND = sorted([*AFTER_FIRST, (1, 10, 4, "assistant"), (1, 11, 5, "user"), (2, 30, 2, "assistant"), (4, 1, 1, "user"), (5, 0, 1, "user")])


def test_growing_input(spark, places):
    put(spark, places["source"], FIRST)
    assert session_archive.run(spark, **places, **OPTIONS) == {"batches": 1, "turns_read": 10, "messages": 4, "sessions": 3, "aside": 2}
    assert numbers(spark, places["target"]) == AFTER_FIRST
    assert session_archive.run(spark, **places, **OPTIONS)["turns_read"] == 0  # nothing new
    put(spark, places["source"], SECOND)
    assert session_archive.run(spark, **places, **OPTIONS) == {"batches": 1, "turns_read": 7, "messages": 5, "sessions": 4, "aside": 2}
    assert numbers(spark, places["target"]) == AFTER_SECOND
    assert session_archive.run(spark, **places, **OPTIONS)["batches"] == 0
    assert numbers(spark, places["target"]) == AFTER_SECOND
    aside = spark.read.parquet(f"{places['target']}/aside").collect()
    assert sorted((r["text"], r["reason"]) for r in aside) == [("again", "not behind the turns before"), ("late", "not behind the turns before"), ("lost", "no conv_id or turn"), ("lost too", "no conv_id or turn")]
    cards = session_archive.table(spark, f"{places['target']}/messages", session_archive.MESSAGES)
    assert cards.filter("conv_id = 1 and number = 2").first()["card"] == "> [!success] Claude · 02\n>\n> b\n> c\n\n^message-02\n\n"


def test_a_batch_that_failed_is_run_again(spark, places, monkeypatch):
    """Its rows are written, but the stream didn't get to say so: the next run writes the same rows again, and goes on."""
    put(spark, places["source"], FIRST)
    session_archive.run(spark, **places, **OPTIONS)
    put(spark, places["source"], SECOND)
    whole = session_archive.archive

    def fails_at_the_end(*x):
        whole(*x)
        raise RuntimeError("executor lost")

    monkeypatch.setattr(session_archive, "archive", fails_at_the_end)
    with pytest.raises(Exception, match="executor lost"):
        session_archive.run(spark, **places, **OPTIONS)
    monkeypatch.setattr(session_archive, "archive", whole)
    assert session_archive.run(spark, **places, **OPTIONS)["messages"] == 5
    assert numbers(spark, places["target"]) == AFTER_SECOND


def test_one_run_or_many_give_the_same(spark, places, tmp_path):
    """Whatever files a run finds, as long as turns come in order."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c}-{t}" if t % 5 else "") for c in range(6) for t in range(20)]
    for part in range(3):
        put(spark, places["source"], [r for r in rows if r[1] * 3 // 20 == part])
        session_archive.run(spark, **places, **OPTIONS)
    once = {k: f"{v}-once" for k, v in places.items()}
    shutil.copytree(places["source"], once["source"])
    session_archive.run(spark, **once, **OPTIONS)
    assert session_archive.run(spark, once["source"], f"{once['target']}-each", f"{once['checkpoint']}-each", **OPTIONS | {"files_per_batch": 1})["batches"] == 3
    assert numbers(spark, places["target"]) == numbers(spark, once["target"]) == numbers(spark, f"{once['target']}-each") and len(numbers(spark, once["target"])) == 96


def test_no_files_and_empty_files(spark, places):
    put(spark, places["source"], [])
    assert session_archive.run(spark, **places, **OPTIONS)["messages"] == 0
    assert numbers(spark, places["target"]) == []


def test_spans_give_the_numbers_of_one_window(spark):
    """A long session is cut into spans; ties and gaps in the order are numbered as by one window."""
    rows = [(1, t * 3 % 700 - 50, "user" if t % 3 else "assistant", None if t % 11 == 0 else f"x{t % 13}") for t in range(900)] + [(2, 10**12, "user", "y")]
    d = spark.createDataFrame(rows, session_archive.TURNS)
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"], r["number"]) for r in messages.numbered(d, span=16).collect())
    kept = sorted(r for r in rows if r[3])
    want = [(*r, sum(x[0] == r[0] for x in kept[:i]) + 1) for i, r in enumerate(kept)]
    assert sorted(want) == got


def test_settings(tmp_path):
    other = tmp_path / "c.json"
    other.write_text(json.dumps({"shelves": 5}))
    assert common.settings("session_archive", str(other)) == {**common.settings("session_archive"), "shelves": 5}
    other.write_text(json.dumps({"shelfs": 5}))
    with pytest.raises(ValueError, match="shelfs"):
        common.settings("session_archive", str(other))
