import pyarrow as pa

from tidepool.functions.batches import bounded
from tidepool.operators.chunking import split_rows
from tidepool.operators.images import references


def test_slices_hold_all_rows_in_order():
    texts = ["aa", None, "", "b" * 50, "ccc", "é" * 3, "d" * 10, None]
    for kind in (pa.string(), pa.binary()):
        b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([t if t is None or kind == pa.string() else t.encode() for t in texts], kind)], names=["id", "text"])
        for limit in (1, 2, 10, 1000):
            parts = list(bounded([b.slice(0, 3), b.slice(3), b.slice(0, 0)], 1, limit))
            assert pa.Table.from_batches(parts).to_pylist() == b.to_pylist()
            sizes = [[len((x["text"] or "").encode() if kind == pa.string() else x["text"] or b"") for x in p.to_pylist()] for p in parts]
            assert all(len(s) == 1 or sum(s) <= limit for s in sizes)


def test_whole_results_from_slices(spark, monkeypatch):
    """Texts longer than a slice, and empty ones and nulls beside them, give what they give by themselves."""
    long = "\n".join(f"## head {i}\nline {i} ![a](x{i}.png)" for i in range(110_000))
    rows = [(0, None), (1, long), (2, ""), (3, "one ![b](y.png)"), (4, long[: 3 << 20])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert len(long) > 4 << 20 and len(long[: 3 << 20]) == 3 << 20
    found = {r["doc_id"]: r["n"] for r in references(df, ["doc_id"], "text").groupBy("doc_id").agg({"nth": "count"}).withColumnRenamed("count(nth)", "n").collect()}
    assert found[1] == 110_000 and found[3] == 1 and set(found) == {1, 3, 4}
    pieces = {r["doc_id"]: r["n"] for r in split_rows(df, "doc_id", "text").groupBy("doc_id").agg({"chunk_ord": "count"}).withColumnRenamed("count(chunk_ord)", "n").collect()}
    assert pieces[0] == pieces[2] == pieces[3] == 1 and pieces[1] == 110_000
