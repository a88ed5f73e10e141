"""The index job: reruns, changed input, rows that can't be indexed, searches over what it wrote, and the command lines."""

import json
import os
import subprocess
import sys

import pytest

from jobs import search_index, session_archive
from tidepool.operators import postings

SCHEMA = "doc_id long, text string, lang string, source string"
ROWS = [(1, "alpha beta beta", "en", "a"), (2, "beta gamma", None, "a"), (3, None, "de", None), (4, "", "en", "b"), (300, "gamma " * 50, "en", "b"), (None, "alpha", "en", "a")]


@pytest.fixture
def places(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "docs"))
    return {"documents": str(tmp_path / "docs"), "target": str(tmp_path / "index")}


def found(spark, target, *terms):
    return [r["doc"] for r in postings.Search(spark, f"{target}/postings", list(terms)).top(10).collect()]


def test_rerun_and_changed_input(spark, places):
    first = search_index.run(spark, **places, span=16)
    assert first["documents_read"] == 6 and first["documents_indexed"] == 5 and first["without_id"] == 1
    rows = lambda: sorted(map(tuple, postings.expanded(postings.read(spark, f"{places['target']}/postings")).collect()))
    before = rows()
    assert search_index.run(spark, **places, span=16) == first and rows() == before
    assert ("beta", 1, 2) in {r[:3] for r in before} and not any(r[1] is None for r in before)
    assert found(spark, places["target"], "alpha") == [1] and found(spark, places["target"], "gamma") == [300, 2]
    # a document goes and another one comes
    spark.createDataFrame([*ROWS[1:], (7, "delta alpha", "en", "a")], SCHEMA).write.mode("overwrite").parquet(places["documents"])
    search_index.run(spark, **places, span=16)
    assert found(spark, places["target"], "alpha") == [7] and found(spark, places["target"], "delta") == [7]
    listed = spark.read.parquet(f"{places['target']}/documents").collect()
    assert sorted(r["doc_id"] for r in listed) == [2, 3, 4, 7, 300] and {r["path"] for r in listed} >= {"a/7.md", "/3.md"}


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "docs"))
    report = search_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "index"), span=16)
    assert report["documents_indexed"] == report["postings"] == report["terms"] == 0
    assert found(spark, str(tmp_path / "index"), "alpha") == []


def test_command_lines(spark, places, tmp_path):
    """Each job from a shell: it makes its session, logs what it read and wrote, and prints its report."""
    turns = str(tmp_path / "turns")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], session_archive.TURNS).write.parquet(turns)
    (tmp_path / "c.json").write_text('{"shelves": 2}')
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    for args, said in (
        (["jobs.search_index", places["documents"], places["target"]], {"documents_indexed": 5}),
        (["jobs.session_archive", turns, str(tmp_path / "out"), str(tmp_path / "mark"), "--config", str(tmp_path / "c.json")], {"messages": 2, "batches": 1}),
        (["jobs.session_archive", turns, str(tmp_path / "out"), str(tmp_path / "mark")], {"messages": 0, "batches": 0}),
    ):
        done = subprocess.run([sys.executable, "-m", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert said.items() <= json.loads(done.stdout.splitlines()[-1]).items()
        assert f"{args[0]} " in done.stderr
    assert session_archive.table(spark, str(tmp_path / "out" / "messages"), session_archive.MESSAGES).count() == 2
