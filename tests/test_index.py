"""The vector index as a sum of runs: small refreshes write little, readers and writers side by side, runs put together."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tidepool.operators import index as I


def embed(size):
    return lambda wanted: wanted.select("key", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.rand(3) + i + F.length("passage")).alias("vector"))


def corpus(spark, n, changed=(), gone=()):
    d = spark.range(n).filter(~F.col("id").isin(list(gone) or [-1])).withColumn("path", F.concat(F.lit("n/"), "id", F.lit(".md")))
    key = F.sha2(F.concat("path", F.when(F.col("id").isin(list(changed) or [-1]), F.lit("new")).otherwise(F.lit(""))), 256)
    return d.select("path", key.alias("fingerprint")), d.select(key.alias("key"), F.col("path").alias("passage"))


def size(folder):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names)


def keys(index):
    return {r["key"] for r in index.read("p")[0].select("key").collect()}


def test_a_small_change_writes_little(spark, tmp_path):
    index = I.VectorIndex(spark, str(tmp_path / "i"))
    index.refresh(*corpus(spark, 6000), "p", embed(128))
    whole, changed = size(tmp_path / "i"), list(range(0, 6000, 100))
    notes, chunks = corpus(spark, 6000, changed)
    out = index.refresh(notes, chunks, "p", embed(128))
    assert (out["embedded_chunks"], out["reused_chunks"], out["removed_notes"]) == (60, 5940, 0)
    assert size(tmp_path / "i") - whole < 0.02 * whole
    vectors, held, _ = index.read("p")
    assert keys(index) == {r["key"] for r in chunks.collect()} and vectors.count() == 6000
    assert not any(I.manifest_changes(notes, held).first())


def test_gone_and_back_again(spark, tmp_path, monkeypatch):
    """Keys and notes that vanish and come back, over more runs than a version has."""
    monkeypatch.setattr(I, "MOST_RUNS", 3)
    index, seen = I.VectorIndex(spark, str(tmp_path / "i")), []
    for i, (changed, gone) in enumerate([((), ()), ((1,), (2, 3)), ((), (4,)), ((), ()), ((1, 5), ()), ((), range(1, 20)), ((), ())]):
        notes, chunks = corpus(spark, 20, changed, gone)
        out = index.refresh(notes, chunks, "p", embed(3))
        want = {r["key"] for r in chunks.collect()}
        vectors, held, info = index.read("p")
        assert keys(index) == want and vectors.count() == len(want) == info["vectors"] == out["embedded_chunks"] + out["reused_chunks"]
        assert not any(I.manifest_changes(notes, held).first()) and info["version"] == i + 1
        seen.append(len(info["runs"]))
    assert max(seen) <= 3 and seen.count(1) >= 2
    assert index.versions("p") == [6, 7]
    named = {r for v in (6, 7) for r in index.version("p", v)["runs"]}
    assert set(os.listdir(tmp_path / "i" / "profile=p" / "runs")) >= named


def test_readers_always_find_a_version(spark, tmp_path):
    index, seen, stop = I.VectorIndex(spark, str(tmp_path / "i")), [], threading.Event()
    index.refresh(*corpus(spark, 5), "p", embed(2))

    def reads():
        while not stop.is_set():
            try:
                seen.append((index.version("p") or {"version": 0})["version"])
            except Exception as e:
                seen.append(repr(e))

    reader = threading.Thread(target=reads)
    reader.start()
    for i in range(1, 4):
        index.refresh(*corpus(spark, 5, changed=[i]), "p", embed(2))
    stop.set()
    reader.join()
    assert all(isinstance(x, int) and x > 0 for x in seen) and seen == sorted(seen) and len(seen) > 5


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    index = I.VectorIndex(spark, str(tmp_path / "i"))
    index.refresh(*corpus(spark, 5), "p", embed(2))
    runs = lambda: set(os.listdir(tmp_path / "i" / "profile=p" / "runs"))

    def overtaken():
        I.VectorIndex(spark, str(tmp_path / "i")).refresh(*corpus(spark, 5, changed=[1]), "p", embed(2))
        return corpus(spark, 5, changed=[2])[0]

    publish = index._publish
    monkeypatch.setattr(index, "_publish", lambda profile, info: publish(profile, info | {"version": 2}))
    with pytest.raises(ValueError, match="published first"):
        index.refresh(*corpus(spark, 5, changed=[2]), "p", embed(2), overtaken)
    assert keys(index) == {r["key"] for r in corpus(spark, 5, changed=[1])[1].collect()}
    assert runs() == set(index.version("p")["runs"]) and not [x for x in os.listdir(tmp_path / "i" / "profile=p" / "versions") if "json" not in x]


def test_failures_leave_the_index_as_it_was(spark, tmp_path):
    index = I.VectorIndex(spark, str(tmp_path / "i"))
    index.refresh(*corpus(spark, 5), "p", embed(2))
    before = keys(index), size(tmp_path / "i")
    for made, rescan, said in ((embed(3), None, "sizes"), (embed(2), lambda: corpus(spark, 4)[0], "changed"), (lambda w: w.select("key", F.array(F.lit(0.0), F.lit(0.0)).alias("vector")), None, "direction")):
        with pytest.raises(Exception, match=said):
            index.refresh(*corpus(spark, 5, changed=[1]), "p", made, rescan)
        assert (keys(index), size(tmp_path / "i")) == before
    out = index.refresh(*corpus(spark, 5, changed=[1]), "p", embed(3), rebuild=True)
    assert out["embedded_chunks"] == 5 and out["dimensions"] == 3 and out["reused_chunks"] == 0
    assert index.refresh(*corpus(spark, 0), "p", embed(3))["removed_notes"] == 5 and keys(index) == set()
