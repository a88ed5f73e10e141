"""A stream of changed notes brings the index up to date; running it again changes nothing."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators.index import VectorIndex
from tidepool.sources.log_stream import stream_logs
from tidepool.streaming.refresh import refresh_on_change


def test_refresh_on_change(spark, tmp_path):
    inbox, index = str(tmp_path / "inbox"), VectorIndex(spark, str(tmp_path / "cache"))
    notes = spark.createDataFrame([("a.md", "1"), ("b.md", "2")], "path string, fingerprint string")
    chunks = spark.createDataFrame([("k1", "one"), ("k2", "two"), ("k2", "two")], "key string, passage string")
    embed = lambda wanted: wanted.select("key", F.array(F.length("passage").cast("double"), F.lit(1.0)).alias("vector"))
    for _ in range(2):
        notes.write.mode("append").parquet(inbox)
        changes = spark.readStream.schema(notes.schema).parquet(inbox)
        refresh_on_change(changes, lambda: (notes, chunks), index, "p", embed, str(tmp_path / "checkpoint")).awaitTermination()
        vectors, old, info = index.read("p")
        assert vectors.count() == 2 and old.count() == 2
    assert info["embedded_chunks"] == 0 and info["reused_chunks"] == 2


def lines_of(folder):
    out = []
    for p in sorted(folder.rglob("*.jsonl")):
        at = 0
        for raw in p.read_bytes().splitlines(keepends=True):
            if raw.endswith(b"\n"):
                out.append((str(p), at, raw[:-1].decode()))
            at += len(raw)
    return sorted(out)


def test_growing_logs_are_read_once(spark, tmp_path):
    """Appended lines, new files, a line that isn't finished, a range border within a character, and a batch that fails."""
    home, mark, seen = tmp_path / "logs", str(tmp_path / "mark"), []
    (home / "deep").mkdir(parents=True)
    (home / "a.jsonl").write_text("".join(f"{i} é🙂\n" for i in range(40)) + '{"cut', encoding="utf-8")
    (home / "none.txt").write_text("no\n")
    fails = []

    def run():
        def batch(rows, number):
            got = [tuple(r) for r in rows.collect()]
            if fails:
                raise RuntimeError(fails.pop())
            seen.append((number, got))

        stream_logs(spark, str(home), rangeBytes=13).writeStream.foreachBatch(batch).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        numbers = [n for n, _ in seen]
        assert len(numbers) == len(set(numbers))
        return sorted(x for _, got in seen for x in got)

    assert run() == lines_of(home) and len(seen[0][1]) == 40
    assert run() == lines_of(home) and sum(len(g) for _, g in seen) == 40  # nothing new
    with (home / "a.jsonl").open("a", encoding="utf-8") as f:
        f.write('": 1}\n\nlast\n')
    (home / "deep" / "b.jsonl").write_bytes(b"one\r\ntwo\nhalf")
    fails.append("executor lost")
    with pytest.raises(Exception, match="executor lost"):
        run()
    assert run() == lines_of(home) and sum(len(g) for _, g in seen) == 45
    with (home / "deep" / "b.jsonl").open("ab") as f:
        f.write(b" done\n")
    assert run() == lines_of(home) and [g for _, g in seen][-1] == [(str(home / "deep" / "b.jsonl"), 9, "half done")]
    (home / "a.jsonl").write_text("shorter\n")
    with pytest.raises(Exception, match="shorter"):
        run()
