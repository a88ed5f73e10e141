"""Line dedup by content-defined chunks of lines.

Lines with text are hashed, with a rolling hash over the last ``SPAN``; a chunk ends after a line whose rolling hash is the
least among its ``LEAST`` - 1 neighbours on either side. So chunk ends depend on nearby lines alone and stay where they are
when lines are inserted or lost elsewhere, and every chunk has at least ``LEAST`` lines with text, unless its document has
fewer. A chunk of so many whose bytes occur before, in a smaller (doc_id, text hash, place), is removed; the first
occurrence stays. Equal 64-bit hashes only nominate: the texts of nominated chunks are joined on their bytes.

With ``runs``, a removed chunk takes with it the lines before and after it that equal those around the first occurrence.
Ends inside a run that two documents share are the same but for two lines at its start and one at its end, so what is left
of a run beside its last equal chunk lies within two chunks: these travel with the chunk, and no more is needed.

A hot chunk is aggregated before the shuffle to its first occurrence, and joins back under adaptive skew handling.

Nulls: a null text stays null and has no lines; a null doc_id sorts first. Rows that repeat doc_id and text are one
document: they are treated alike, and their chunks stay where the first occurrence is theirs. An empty text is one empty
line. Blank lines don't count towards ``LEAST``. All columns are kept, whatever their names, but one named
line_dedup, whose place the result takes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import GOLD, Sieve, chunks, maybe_among, mix, only, staged, text_array

SPAN, LEAST = 2, 2
_CHUNK = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), *[(c, pa.string()) for c in ("body", "before", "after")]])
_DDL = "h long, doc_id long, row long, start int, stop int, body string, before string, after string"


def chunk_lines(lines: list[str], least: int = LEAST) -> list[tuple[int, int]]:
    """(start, stop) of the content-defined chunks of lines."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    if len(full) < 2 * least:
        return [(0, len(lines))]
    h = np.fromiter((xxhash.xxh3_64_intdigest(lines[i]) for i in full), dtype=np.uint64, count=len(full))
    rolling = h.copy()
    for k in range(1, SPAN):
        rolling[k:] = mix(rolling[k:] + GOLD) + h[:-k]
    rolling = mix(rolling)
    end = np.zeros(len(full), dtype=bool)
    end[least - 1 : len(full) - least] = True  # so many lines with text before the first end and after the last
    for k in range(1, least):
        end[k:] &= rolling[k:] < rolling[:-k]
        end[:-k] &= rolling[:-k] <= rolling[k:]
    cuts = [0, *[full[i] + 1 for i in np.flatnonzero(end).tolist()], len(lines)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _row(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(text, doc_id)


def line_chunks(documents: DataFrame, least: int = LEAST, among: Sieve | None = None, runs: bool = False) -> DataFrame:
    """h, doc_id, row, start, stop, body, before, after: the chunks of enough lines.

    Bodies only where a sieve of hashes is given; with ``runs`` also the two chunks before and after (null where there is none).
    """
    sieve = documents.sparkSession.sparkContext.broadcast(among) if among is not None else None
    rows = only(documents, doc_id="doc_id", text="text").filter(F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=8 << 20):
            at, start, stop, edges, bodies = [], [], [], [], []
            texts = [text.split("\n") for text in text_array(b).to_pylist()]
            for i, lines in enumerate(texts):
                if len(lines) < least:
                    continue
                found = chunk_lines(lines, least)
                for k, (s, e) in enumerate(found):
                    if e - s >= least and sum(1 for x in lines[s:e] if x.strip()) >= least:
                        at.append(i)
                        start.append(s)
                        stop.append(e)
                        edges.append((found[max(k - 2, 0)][0], found[min(k + 2, len(found) - 1)][1]))
                        bodies.append("\n".join(lines[s:e]))
            h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in bodies), dtype=np.uint64, count=len(bodies))
            keep = np.flatnonzero(sieve.value.test(h)) if sieve is not None else np.arange(len(h))
            picked = np.array(at, dtype=np.int64)[keep]
            body = pa.array([bodies[k] for k in keep.tolist()] if sieve is not None else [None] * len(keep), pa.string())
            around = [[None] * len(keep)] * 2
            if sieve is not None and runs:
                around = [["\n".join(texts[at[k]][s:e]) if s < e else None for k in keep.tolist() for s, e in [span(k)]] for span in (lambda k: (edges[k][0], start[k]), lambda k: (stop[k], edges[k][1]))]
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), b.column(0).take(pa.array(picked)), b.column(2).take(pa.array(picked)), pa.array(np.array(start, dtype=np.int32)[keep]), pa.array(np.array(stop, dtype=np.int32)[keep]), body, *[pa.array(x, pa.string()) for x in around]], schema=_CHUNK)

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row(F.col("doc_id").cast("long"), F.col("text")).alias("row")).mapInArrow(cut, _DDL)


def _alike(x: Column, y: Column, backwards: bool) -> Column:
    """How many lines of two texts are equal from their starts, or from their ends; 0 where one is null."""
    a, b = (F.reverse(F.split(c, "\n", -1)) if backwards else F.split(c, "\n", -1) for c in (x, y))
    same = F.zip_with(a, b, lambda p, q: F.coalesce(p == q, F.lit(False)))  # what one lacks is null there
    first = F.array_position(same, False)
    return F.when(x.isNull() | y.isNull(), 0).when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, cuts: sorted ranges that may overlap, as ranges that do not."""
    for b in batches:
        out = []
        for cuts in b.column(2).to_pylist():
            whole: list[dict] = []
            for c in cuts:
                if whole and c["start"] <= whole[-1]["stop"]:
                    whole[-1]["stop"] = max(whole[-1]["stop"], c["stop"])
                else:
                    whole.append(c)
            out.append(whole)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["doc_id", "row", "cuts"])


def removals(documents: DataFrame, least: int = LEAST, runs: bool = False) -> DataFrame:
    """doc_id, row, cuts: the line ranges (start, stop) to remove from each document, in order."""
    hashes = line_chunks(documents, least).select("h", "doc_id", "row", "start").distinct()
    twice = staged(hashes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    bodies = staged(line_chunks(documents, least, Sieve.of(twice, "h"), runs).dropDuplicates(["h", "doc_id", "row", "start"]))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", "start")
    if not runs:
        first = bodies.groupBy("h", "body").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "body", "first")
        later = bodies.join(first, ["h", "body"]).filter(F.col("first") < place)
        return later.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    around = F.struct(place.alias("place"), "before", "after")
    first = bodies.groupBy("h", "body").agg(F.min(around).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "body", "first")
    later = bodies.join(first, ["h", "body"]).filter(F.col("first.place") < place)
    wider = later.select("doc_id", "row", (F.col("start") - _alike(F.col("before"), F.col("first.before"), True)).alias("start"), (F.col("stop") + _alike(F.col("after"), F.col("first.after"), False)).alias("stop"))
    cuts = wider.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    return cuts.mapInArrow(_united, "doc_id long, row long, cuts array<struct<start:int,stop:int>>")


def dedup_lines(documents: DataFrame, least: int = LEAST, runs: bool = False) -> DataFrame:
    """The documents with repeated chunks taken out of their text, and line_dedup: n_lines, n_removed beside the columns.

    A column of the documents that is named line_dedup itself is replaced.

    With ``runs``, also the lines beside a repeated chunk as far as they equal those beside its first occurrence.
    """
    names = {c.lower(): c for c in documents.columns}
    found = staged(removals(documents, least, runs))
    doc_id, text = F.col("own_id"), F.col("own_text")
    # the row is carried as one struct, so that no name of its columns clashes
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"), F.col(f"`{names['doc_id']}`").cast("long").alias("own_id"), F.col(f"`{names['text']}`").cast("string").alias("own_text"))
    rows = rows.withColumn("own_row", _row(doc_id, text))
    hit = maybe_among(found, "row")(F.col("own_row"))  # the others have nothing to lose and stay where they are
    cut = rows.filter(hit).join(found, doc_id.eqNullSafe(F.col("doc_id")) & (F.col("own_row") == F.col("row")), "left").select("whole", "own_text", "cuts")
    joined = cut.unionByName(rows.filter(~hit).select("whole", "own_text", F.lit(None).cast(found.schema["cuts"].dataType).alias("cuts")))
    lines, cuts = F.split(text, "\n", -1), F.col("cuts")
    n = F.size(lines)
    kept = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["stop"]).alias("start"), F.when(i == F.size(cuts), n).otherwise(F.get(cuts, i)["start"]).alias("stop")))
    left = F.array_join(F.flatten(F.transform(F.filter(kept, lambda k: k["stop"] > k["start"]), lambda k: F.slice(lines, k["start"] + 1, k["stop"] - k["start"]))), "\n")
    gone = F.aggregate(cuts, F.lit(0), lambda s, c: s + c["stop"] - c["start"])
    out = [(F.when(cuts.isNull(), text).otherwise(left) if c == names["text"] else F.col("whole").getField(c)).alias(c) for c in documents.columns if c.lower() != "line_dedup"]
    return joined.select(*out, F.struct(F.when(text.isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed")).alias("line_dedup"))
