"""SimHash near-duplicates: fingerprints over word shingles, linked by BK-trees.

Two fingerprints that differ in at most ``RADIUS`` bits are equal in some ``kept`` of ``RADIUS + kept`` runs of bits (each
differing bit spoils one run), so each is a member of one bucket per choice of runs, and the bits of these runs name it. In
every bucket the distinct fingerprints grow a BK-tree: a child hangs below its parent at the key of their Hamming
distance, and a search at distance d from a node follows the edges from d - RADIUS to d + RADIUS only. Shards of trees are
built by tasks and broadcast, at most ``BROADCAST_BYTES`` at a time; all fingerprints look for their buckets' trees in a
broadcast shard where they lie, without a shuffle. Each broadcast reads all fingerprints, so there are ``PASSES`` at most:
with more trees than that, those that are all of their bucket aren't broadcast, since all who would search one are its nodes,
and the task that built it has searched it for each of them. Only trees that share a bucket with others are then.

Equal fingerprints are one node. A tree's own links are known as it is built: its nodes carry the component that they form
in it, and a search reports each of those that it meets once, so a group of G near copies makes some G links, not G * G.

Rows: a null, empty or blank text has the fingerprint zero, and is linked like any other; repeated rows stay; a null doc_id is
larger than all others as a component's id; an empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import GOLD, WHITE, chunks, gathered, give_back, mix, only, staged, text_array, unstage
from tidepool.llm.jaccard_join import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bytes of text, and shingles, that a kernel holds at a time.
TEXT_BYTES, SHINGLES = 4 << 20, 1 << 16
#: Fingerprints of a bucket that choosing more runs aims at; nodes of a tree (a larger bucket has several), nodes of a shard.
BUCKET, TREE, SHARD = 256, 1 << 14, 1 << 16
#: Bytes of trees that are broadcast at a time.
BROADCAST_BYTES = 48 << 20
#: Broadcasts of that size that all trees may take.
PASSES = 16
#: Pairs of a fingerprint and a node that a search holds at a time.
FRONTIER = 1 << 21
#: Rows of large buckets that are broadcast at most, some 40 bytes each; beyond that they are joined.
BROADCAST_LARGE = 100_000


def fingerprints_of(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    n = len(texts)
    counts, totals = np.zeros((n, 64), dtype=np.int64), np.zeros(n, dtype=np.int64)
    flat = pc.ascii_lower(texts)
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    edges = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset : flat.offset + n + 1].astype(np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    # words as ranges of bytes; a word ends at its text's end
    word = ~WHITE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begins = edges[:-1][edges[:-1] < len(data)]
    ends = edges[1:][edges[1:] > 0] - 1
    first[begins] = word[begins]
    last[ends] = word[ends]
    # words apart by one space: of the white bytes after a word one stays
    white = np.zeros(len(data), dtype=bool)
    white[1:] = last[:-1] & ~word[1:]
    kept = word | white
    place = np.cumsum(kept)
    starts, stops = place[first] - 1, place[last]
    per_text = np.diff(np.searchsorted(np.flatnonzero(first), edges))
    line = np.where(white, np.uint8(0x20), data)[kept].tobytes()
    del word, first, last, white, kept, place
    own = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(per_text, out=own[1:])
    windows = np.where(per_text > 0, np.maximum(per_text - size + 1, 1), 0)
    begin, offsets = gathered(np.arange(len(starts) + 1), own[:-1], windows)
    end = np.minimum(begin + size, np.repeat(own[1:], windows)) - 1
    text_of = np.repeat(np.arange(n), windows)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begin), SHINGLES):
        part = slice(at, at + SHINGLES)
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[begin[part]].tolist(), stops[end[part]].tolist(), strict=True)], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        ids = text_of[part]
        cuts = np.flatnonzero(np.diff(ids, prepend=-1))
        counts[ids[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    totals[:] = np.diff(offsets)
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


class Forest:
    """BK-trees side by side. ``edge`` is a node's Hamming distance to its ``parent`` (-1 at a root)."""

    def __init__(self, values: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.values, self.parent, self.edge = values, parent, edge
        key = parent.astype(np.int64) * 65 + edge
        inner = np.flatnonzero(parent >= 0)
        self.children = inner[np.argsort(key[inner], kind="stable")]
        self.keys = key[self.children]

    @classmethod
    def grown(cls, values: np.ndarray, roots: np.ndarray, tree: np.ndarray) -> Forest:
        """The trees that inserting the values in their order makes; ``roots`` is each tree's first, ``tree`` that of each value."""
        parent, edge = np.full(len(values), -1, dtype=np.int32), np.zeros(len(values), dtype=np.uint8)
        waiting = np.setdiff1d(np.arange(len(values)), roots)
        above = roots[tree[waiting]]
        while len(waiting):
            d = np.bitwise_count(values[waiting] ^ values[above]).astype(np.int64)
            _, first, group = np.unique(above * 65 + d, return_index=True, return_inverse=True)
            new = waiting[first]
            parent[new], edge[new] = above[first], d[first]
            rest = np.ones(len(waiting), dtype=bool)
            rest[first] = False
            waiting, above = waiting[rest], new[group[rest]]
        return cls(values, parent, edge)

    def near(self, probes: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of a probe, node) for all nodes within the radius of a probe in the tree that it starts at."""
        q, node = np.arange(len(probes)), starts
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            d = np.bitwise_count(probes[q] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], node[hit]))
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            q = np.repeat(q, high - low)
            node, _ = gathered(self.children, low, high - low)
        return np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])

    def searches(self, probes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``near`` in parts, none of which can meet more than ``FRONTIER`` nodes (but for one probe in a large tree)."""
        work = np.cumsum(sizes)
        at = 0
        while at < len(probes):
            stop = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + FRONTIER, side="right")))
            q, node = self.near(probes[at:stop], starts[at:stop], radius)
            yield q + at, node
            at = stop

    def labels(self, roots: np.ndarray, tree: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
        """The first node of each node's component within its tree."""
        label = np.arange(len(self.values))
        for q, node in self.searches(self.values, roots[tree], sizes[tree], radius):
            while True:
                a, b = label[q], label[node]
                apart = a != b
                if not apart.any():
                    break
                np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
                while not np.array_equal(deeper := label[label], label):
                    label = deeper
                q, node = q[apart], node[apart]
        return label


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """The bits of each choice of runs; more runs are chosen, and so buckets are smaller, the more fingerprints there are."""
    kept = 1
    while kept < radius and n >> (64 * kept // (radius + kept)) > BUCKET:
        kept += 1
    cuts = [64 * i // (radius + kept) for i in range(radius + kept + 1)]
    runs = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(runs, kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_keys(fp: np.ndarray, which: np.ndarray | int, mask: np.ndarray | int) -> np.ndarray:
    """A 64-bit name of a bucket. Two buckets of one name only cost a search in vain."""
    return mix((fp & np.uint64(mask)) ^ mix(np.uint64(which) + np.full(len(fp), GOLD)))


def _shards(nodes: DataFrame, chosen: list[int]) -> DataFrame:
    """Packed trees, a row a shard: names and roots of the trees, and of all nodes value, parent, edge and label.

    Trees that are all of their bucket and those that are a part of it lie in shards of their own, ``whole`` or not.
    """
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in chosen])).alias("which", "bits"))
    large = staged(keyed.groupBy("which", "bits").count().filter(F.col("count") > TREE))
    several = large.count()
    part, whole = F.lit(0), F.lit(True)
    if several:
        large = large.select("which", "bits", F.ceil(F.col("count") / F.lit(TREE)).alias("parts"))
        keyed = keyed.join(F.broadcast(large) if several <= BROADCAST_LARGE else large, ["which", "bits"], "left")
        part, whole = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("parts")), F.lit(0)), F.col("parts").isNull()
    total = max(1, -(-nodes.count() * len(chosen) // SHARD))
    ddl = "shard long, whole boolean, names binary, roots binary, fps binary, parent binary, edge binary, label binary"
    schema = pa.schema([("shard", pa.int64()), ("whole", pa.bool_()), *[(c, pa.binary()) for c in ("names", "roots", "fps", "parent", "edge", "label")]])

    def grown(key: tuple, rows: pa.Table) -> pa.Table:
        which, part = (rows.column(c).to_numpy() for c in ("which", "part"))
        fp = rows.column("fp").to_numpy().view(np.uint64)
        bits = np.array(chosen, dtype=np.uint64)[which]
        name = mix((fp & bits) ^ mix(which.astype(np.uint64) + GOLD))
        order = np.lexsort((fp, part, name))
        fp, name, part = fp[order], name[order], part[order]
        starts = np.ones(len(fp), dtype=bool)
        starts[1:] = (name[1:] != name[:-1]) | (part[1:] != part[:-1])
        roots = np.flatnonzero(starts)
        tree, sizes = np.cumsum(starts) - 1, np.diff(np.append(roots, len(fp)))
        forest = Forest.grown(fp, roots, tree)
        label = forest.labels(roots, tree, sizes, RADIUS)
        packed = [name[roots].tobytes(), roots.astype(np.int32).tobytes(), fp.tobytes(), forest.parent.tobytes(), forest.edge.tobytes(), label.astype(np.int32).tobytes()]
        give_back()
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()]), *[pa.array([x], pa.binary()) for x in packed]], schema=schema)

    dealt = keyed.select("fp", "which", F.pmod(F.xxhash64("which", "bits", part), F.lit(total)).alias("shard"), whole.alias("whole"), part.cast("long").alias("part"))
    out = staged(dealt.groupBy("shard", "whole").applyInArrow(grown, ddl))
    unstage(large)
    return out


class Trees:
    """Shards of trees that are searched together."""

    def __init__(self, rows: list):
        base = np.cumsum([0, *[len(r["fps"]) // 8 for r in rows]])
        of = lambda c, kind: [np.frombuffer(r[c], dtype=kind) for r in rows]
        parent = np.concatenate([np.where(x < 0, -1, x + b) for x, b in zip(of("parent", np.int32), base, strict=False)])
        self.forest = Forest(np.concatenate(of("fps", "<u8")), parent, np.concatenate(of("edge", np.uint8)))
        self.label = np.concatenate([x + b for x, b in zip(of("label", np.int32), base, strict=False)])
        names, roots = np.concatenate(of("names", "<u8")), np.concatenate([x + b for x, b in zip(of("roots", np.int32), base, strict=False)])
        sizes = np.diff(np.append(roots, base[-1]))
        order = np.argsort(names, kind="stable")
        self.names, self.roots, self.sizes = names[order], roots[order], sizes[order]

    def links(self, fp: np.ndarray, chosen: list[int]) -> np.ndarray:
        """Pairs of a fingerprint and another one that links reach from it, one for each component of a tree that it meets."""
        out = [np.zeros((0, 2), dtype=np.uint64)]
        for which, m in enumerate(chosen):
            key = bucket_keys(fp, which, m)
            low, high = np.searchsorted(self.names, key), np.searchsorted(self.names, key, side="right")
            tree, _ = gathered(np.arange(len(self.names)), low, high - low)
            own = np.repeat(fp, high - low)
            for q, node in self.forest.searches(own, self.roots[tree], self.sizes[tree], RADIUS):
                pairs = np.unique(np.stack([own[q], self.forest.values[self.label[node]]], axis=1), axis=0)
                out.append(pairs[pairs[:, 0] != pairs[:, 1]])
        return np.unique(np.concatenate(out), axis=0)


def _own_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: each node of a tree and the first of its component in that tree, of shards' fps and labels."""
    for b in batches:
        for fps, label in zip(b.column(0), b.column(1), strict=True):
            values, first = np.frombuffer(fps.as_py(), dtype=np.int64), np.frombuffer(label.as_py(), dtype=np.int32)
            linked = np.flatnonzero(first != np.arange(len(first)))
            yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[first[linked]])], names=["a", "b"])


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links enough that components over them are those over all pairs of the column fp within the radius."""
    chosen = masks(nodes.count())
    shards = _shards(nodes, chosen)
    sizes = shards.select("shard", "whole", F.expr("length(names) + length(roots) + length(fps) + length(parent) + length(edge) + length(label)").alias("bytes"))
    spark, parts = nodes.sparkSession, []
    if (sizes.agg(F.sum("bytes")).first()[0] or 0) > PASSES * BROADCAST_BYTES:
        parts.append(staged(shards.filter("whole").select("fps", "label").mapInArrow(_own_links, "a long, b long")))
        sizes = sizes.filter(~F.col("whole"))
    passes: list[list[tuple[int, bool]]] = []
    room = 0
    for r in sizes.orderBy("shard", "whole").toLocalIterator():  # two numbers a shard
        if r["bytes"] > room or not passes:
            passes.append([])
            room = BROADCAST_BYTES
        passes[-1].append((r["shard"], r["whole"]))
        room -= r["bytes"]
    for those in passes:
        wanted = F.lit(False)
        for kind in (True, False):
            wanted |= (F.col("whole") == kind) & F.col("shard").isin([s for s, w in those if w == kind])
        held = spark.sparkContext.broadcast(shards.filter(wanted).collect())

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = None
            for b in batches:
                trees = trees or Trees(held.value)  # noqa: B023
                pairs = trees.links(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), chosen).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            del trees
            give_back()

        parts.append(staged(nodes.select("fp").mapInArrow(searched, "a long, b long")))
        held.destroy()
    unstage(shards)
    found = spark.createDataFrame([], "a long, b long")
    return found if not parts else spark.read.schema(found.schema).parquet(*[f for p in parts for f in {x.rsplit("/", 1)[0] for x in p.inputFiles()}])


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of fingerprints reach."""
    kind = dict((c.lower(), t) for c, t in documents.dtypes)["doc_id"]
    rows = only(documents, doc_id="doc_id", text="text")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(text_array(b)).view(np.int64))], names=["doc_id", "fp"])

    prints = staged(rows.mapInArrow(printed, f"doc_id {kind}, fp long"))
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = links(nodes)
    labels = staged(components(found))
    named = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    ids = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    classes = staged(named.join(ids, "comp").select("fp", "component_id"))
    unstage(nodes, labels, found)
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
