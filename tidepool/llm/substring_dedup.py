"""Substring dedup by compaction of a token De Bruijn graph.

Edges of the graph are windows of ``WINDOW`` words. Only repeated ones matter, so three steps thin the graph first:

1. The smallest hash among a window's shorter k-mers is a function of its words, so windows with equal words have equal
   minimisers. Minimisers met in two documents go into a sieve (a Bloom filter of bounded size, broadcast).
2. Windows whose minimiser passes are edges. Within a chunk of text, an edge of several documents is settled at once
   against the smallest doc_id; only that document's edges are dealt out by hash, as packed arrays, so a hot passage
   leaves a chunk once. The task of a hash range finds each edge's smallest doc_id and place: its source coordinates.
3. Consecutive edges of a document whose sources are consecutive as well form one nonbranching path: they compact to
   (doc, start, length, source doc, source start).

The distinct source ranges are joined to their documents and digested, the digests are joined to the paths, and a path
counts only if the document's own words have the digest of its source: hashes alone remove nothing.

Contract: a word goes if a window that covers it starts, word for word, in a document with a smaller doc_id too; windows
are judged on the input. Nulls: a null text has no words; a null doc_id counts as smaller than all others. Repeated
rows, having equal ids, don't affect each other; rows that share an id but not the text are cut only where verified. Words
are ``[^\\x20\\x09-\\x0D]+``, unchanged. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import Sieve, buckets_for, chunks, mix, only, owners, staged, text_array, text_bytes, words_of

WINDOW, KMER = 13, 5
#: Text bytes of a chunk, and of a hash range.
CHUNK_TEXT, RANGE_TEXT = 3 << 20, 12 << 20
#: Chunks whose edges meet in one group before all of a hash range do.
GROUP_CHUNKS = 1024
NO_ID = -(1 << 63)

_HASHES = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("many", pa.binary())])
_EDGES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("settled", pa.bool_()), ("h", pa.binary()), ("doc", pa.binary()), ("at", pa.binary()), ("source", pa.binary()), ("source_at", pa.binary())])
_EDGES_DDL = "bucket int, chunk long, settled boolean, h binary, doc binary, at binary, source binary, source_at binary"
_PATHS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("edges", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])
_PATHS_DDL = "doc_id long, start int, edges int, source long, source_start int"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    r = np.random.default_rng(n)
    out = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for i in range(n):
        out += words[i : i + len(out)] * np.uint64(int(r.integers(1 << 62)) * 2 + 1)
    return mix(out)


class Windows:
    """All windows of a chunk: ``hash``, ``minimiser``, ``doc`` (index of the text) and ``at`` (place in its text)."""

    def __init__(self, texts: pa.Array, window: int, kmer: int):
        words = words_of(texts, lower=False)
        h = words.hashes()
        doc = owners(words.offsets)
        n = len(h) - window + 1
        if n <= 0:
            self.start = np.zeros(0, dtype=np.int64)
        else:
            self.start = np.flatnonzero(doc[:n] == doc[window - 1 :])
        self.doc = doc[self.start]
        self.at = (self.start - words.offsets[:-1][self.doc]).astype(np.int32)
        short = _rolled(h, kmer)
        low, have = short, 1
        want = window - kmer + 1
        while have < want:  # minimum over `have` k-mers, doubled
            step = min(have, want - have)
            low = np.minimum(low[: max(len(low) - step, 0)], low[step:])
            have += step
        self.minimiser = low[self.start]
        self.words, self.window = h, window

    def hashes(self, picked: np.ndarray) -> np.ndarray:
        return _rolled(self.words, self.window)[self.start[picked]]


def _dealt(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def repeated_minimisers(rows: DataFrame, buckets: int, window: int, kmer: int) -> DataFrame:
    """h: minimisers that occur in two documents, or in two chunks."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=CHUNK_TEXT):
            w = Windows(text_array(b), window, kmer)
            if not len(w.doc):
                continue
            fresh = np.r_[True, (w.minimiser[1:] != w.minimiser[:-1]) | (w.doc[1:] != w.doc[:-1])]
            h, doc = w.minimiser[fresh], w.doc[fresh]
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            last = np.r_[first[1:], len(h)] - 1
            many = doc[first] != doc[last]  # the sort is stable, so texts are in order within a hash
            h = h[first]
            edges = np.searchsorted(_dealt(h, buckets), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary()) for x in (h, many))], schema=_HASHES)

    def repeated(rows: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(rows.column("h").to_pylist()), dtype=np.uint64)
        many = np.frombuffer(b"".join(rows.column("many").to_pylist()), dtype=bool)
        values, at, n = np.unique(h, return_inverse=True, return_counts=True)
        keep = n > 1
        keep[at[many]] = True
        return pa.table({"h": pa.array(values[keep].view(np.int64))})

    return rows.mapInArrow(met, "bucket int, h binary, many binary").groupBy("bucket").applyInArrow(repeated, "h long")


def _joined(rows: pa.Table, column: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), dtype=dtype)


def _runs(doc: np.ndarray, at: np.ndarray, source: np.ndarray, source_at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Compact edges to paths: (doc, start, edges, source, source start)."""
    order = np.lexsort((source_at, source, at, doc))
    doc, at, source, source_at = doc[order], at[order], source[order], source_at[order]
    if not len(doc):
        return doc, at, at, source, source_at
    once = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])]  # one source is enough
    doc, at, source, source_at = doc[once], at[once], source[once], source_at[once]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (source_at[1:] != source_at[:-1] + 1)])
    return doc[new], at[new], np.diff(np.r_[new, len(doc)]).astype(np.int32), source[new], source_at[new]


def paths(rows: DataFrame, sieve: Sieve, buckets: int, window: int, kmer: int, groups: int = 1) -> DataFrame:
    """doc_id, start, edges, source, source_start: compacted paths of windows that start in a smaller document too."""
    known = rows.sparkSession.sparkContext.broadcast(sieve)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for b in chunks(batches, limit=CHUNK_TEXT):
            w = Windows(text_array(b), window, kmer)
            picked = np.flatnonzero(known.value.test(w.minimiser))
            h, doc, at = w.hashes(picked), b.column(0).to_numpy(zero_copy_only=False)[w.doc[picked]], w.at[picked]
            order = np.lexsort((at, doc, h))
            h, doc, at = h[order], doc[order], at[order]
            chunk, nth = (part << 24) + nth, nth + 1
            if not len(h):
                continue
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            of = np.repeat(first, np.diff(np.r_[first, len(h)]))
            lead = doc == doc[of]
            own = _runs(doc[~lead], at[~lead], doc[of][~lead], at[of][~lead])
            h, doc, at = h[lead], doc[lead], at[lead]
            edges = np.searchsorted(_dealt(h, buckets), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges)).tolist()
            empty = [b""] * len(full)
            cut = [pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary()) for x in (h, doc, at)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full)), pa.array([False] * len(full)), *cut, pa.array(empty, pa.binary()), pa.array(empty, pa.binary())], schema=_EDGES)
            if len(own[0]):
                yield pa.RecordBatch.from_arrays([pa.array([chunk % buckets], pa.int32()), pa.array([chunk]), pa.array([True]), *(pa.array([x.tobytes()], pa.binary()) for x in (own[2], own[0], own[1], own[3], own[4]))], schema=_EDGES)

    def sourced(bucket: int, rows: pa.Table, last: bool) -> pa.Table:
        """The edges of a hash range whose smallest document is another one, back by chunk; unless it's the ``last`` time, also those of the smallest.

        Settled paths, and what went back before, pass through.
        """
        through = pa.compute.greater(pa.compute.binary_length(rows.column("source")), 0)
        out, rows = [rows.filter(through)], rows.filter(pa.compute.invert(through))
        sizes = [len(x) // 8 for x in rows.column("h").to_pylist()]
        chunk = np.repeat(rows.column("chunk").to_numpy(), sizes)
        h, doc, at = _joined(rows, "h", np.uint64), _joined(rows, "doc", np.int64), _joined(rows, "at", np.int32)
        order = np.lexsort((at, doc, h))
        h, doc, at, chunk = h[order], doc[order], at[order], chunk[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        of = np.repeat(first, np.diff(np.r_[first, len(h)]))
        later = doc != doc[of]
        for some, known in ((later, True), (~later, False)) if not last else ((later, True),):
            index = np.flatnonzero(some)
            index = index[np.argsort(chunk[index], kind="stable")]
            ends = np.flatnonzero(np.r_[True, np.diff(chunk[index]) != 0, True]) if len(index) else np.zeros(1, np.int64)
            cuts = [index[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            empty = [b""] * len(cuts)
            columns = [empty if known else [h[i].tobytes() for i in cuts], *([x[i].tobytes() for i in cuts] for x in (doc, at)), *([x[of[i]].tobytes() for i in cuts] if known else empty for x in (doc, at))]
            out.append(pa.Table.from_arrays([pa.array([bucket] * len(cuts), pa.int32()), pa.array([int(chunk[i[0]]) for i in cuts], pa.int64()), pa.array([False] * len(cuts)), *(pa.array(x, pa.binary()) for x in columns)], schema=_EDGES))
        return pa.concat_tables([t.cast(_EDGES) for t in out])

    def compacted(rows: pa.Table) -> pa.Table:
        own, edges = (rows.filter(m) for m in (rows.column("settled"), pa.compute.invert(rows.column("settled"))))
        parts = _runs(_joined(edges, "doc", np.int64), _joined(edges, "at", np.int32), _joined(edges, "source", np.int64), _joined(edges, "source_at", np.int32))
        own = (_joined(own, "doc", np.int64), _joined(own, "at", np.int32), _joined(own, "h", np.int32), _joined(own, "source", np.int64), _joined(own, "source_at", np.int32))
        return pa.Table.from_arrays([pa.array(np.concatenate([a, b])) for a, b in zip(own, parts, strict=True)], schema=_PATHS)

    edges = rows.mapInArrow(dealt, _EDGES_DDL)
    if groups > 1:
        # chunks meet in groups first, so that of a hot window one a group goes on, not one a chunk
        grouped = edges.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups))).groupBy("bucket", "group")
        edges = grouped.applyInArrow(lambda key, t: sourced(key[0].as_py(), t.select(_EDGES.names), False), _EDGES_DDL)
    edges = edges.groupBy("bucket").applyInArrow(lambda key, t: sourced(key[0].as_py(), t, True), _EDGES_DDL)
    return edges.groupBy("chunk").applyInArrow(compacted, _PATHS_DDL)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def _among(rows: DataFrame, ids: DataFrame, inside: bool) -> DataFrame:
    """The rows whose doc_id a sieve of ids lets through, or those that it holds back."""
    sieve = rows.sparkSession.sparkContext.broadcast(Sieve.of(ids, "doc_id"))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sieve.value.test(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) == inside))

    return rows.mapInArrow(thinned, "doc_id long, text string")


def dedup_substrings(documents: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that stay, joined by one space."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
    rows = only(documents, doc_id="doc_id", text="text").select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = text_bytes(rows)
    buckets = buckets_for(size, RANGE_TEXT, 4)
    sieve = Sieve.of(staged(repeated_minimisers(rows, buckets, window, kmer)), "h")
    found = staged(paths(rows, sieve, buckets, window, kmer, buckets_for(size, CHUNK_TEXT * GROUP_CHUNKS)))

    # the sources, read once each in their own documents
    ranges = staged(found.select("source", "source_start", "edges").distinct())
    wanted = ranges.groupBy(F.col("source").alias("doc_id")).agg(F.collect_list(F.struct("source_start", "edges")).alias("ranges"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for i, text, own in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.encode().split()
                out += [(i, r["source_start"], r["edges"], _digest(words[r["source_start"] : r["source_start"] + r["edges"] + window - 1])) for r in own]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["source", "source_start", "edges", "digest"])

    origins = _among(rows, ranges.select(F.col("source").alias("doc_id")).distinct(), True).join(wanted, "doc_id")
    digests = origins.mapInArrow(digested, "source long, source_start int, edges int, digest binary").distinct()
    checked = found.join(digests, ["source", "source_start", "edges"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "edges", "digest")).alias("cuts"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, gone, left = [], [], [], []
            cuts = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            for i, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), cuts, strict=True):
                words = text.encode().split()
                keep = words
                if own:
                    stay = np.ones(len(words), dtype=bool)
                    for c in own:
                        stop = c["start"] + c["edges"] + window - 1
                        if stop <= len(words) and _digest(words[c["start"] : stop]) == c["digest"]:
                            stay[c["start"] : stop] = False
                    keep = [x for x, s in zip(words, stay.tolist(), strict=True) if s]
                ids.append(None if i == NO_ID else i)
                sizes.append(len(words))
                gone.append(len(words) - len(keep))
                left.append(b" ".join(keep).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], schema=_OUT)

    ddl, touched = "doc_id long, n_words long, n_removed long, kept string", found.select("doc_id").distinct()
    cut = _among(rows, touched, True).join(checked, "doc_id", "left").mapInArrow(kept, ddl)
    return cut.unionByName(_among(rows, touched, False).mapInArrow(kept, ddl))
