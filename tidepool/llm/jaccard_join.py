"""N-gram Jaccard join by filtering under several global token orders, and its connected components.

Texts become sets of word shingles. Equal sets are one node. Sets with Jaccard similarity of at least t share a token among
the first n - ceil(t * n) + 1 of either in any order of all tokens, so the filters of several orders may be intersected:

* Order 1 puts frequent tokens last (by a sketch of fixed size, counted over all documents), longer ones first, then a
  hash. Its prefixes are the postings; a frequent passage so doesn't make postings of everything that holds it. A token is
  frequent if its counter stands out from the others' spread, which grows as the root of the input, as passages don't.
* A posting is cut where the set sizes in it leave a gap that no linked pair can span.
* Nodes that share a posting are compared by length, by the symmetric difference of parity bitmaps (never more than the
  true one), by shared prefix tokens under orders 2 and 3, two hashes of their own, and by 32-bit tokens (which never
  share less than the sets do).
* What remains is verified on the exact sets. Only pairs that join two components are verified, so a group of copies costs
  about one verification a member, not one for each pair. Pairs that fail are left out and others tried, in rounds, until
  none is left. So no link that joins components is lost.

Small bitmaps, at most one bit a token (two at rounding up), first leave out of each posting who has no possible partner in it. Copies share many
postings, so a node's other filters are not sent to each: its home is the largest posting that it stays in. Nodes are
compared within their homes first. Then each visits the larger homes whose residents it shares another posting with,
once each. Large homes are in blocks: all blocks have one leader in the first round; after it, who is not of a
home's largest component meets all others.

Nulls: a null text, like one without words, has the empty set and is linked with nothing; a null doc_id counts as smaller
than all others (a component that holds it has a null id). Repeated rows have the same set. Texts with fewer words
than a shingle are one shingle. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import GOLD, Sieve, buckets_for, chunks, maybe_among, mix, only, staged, text_array, text_bytes, unstage, words_of
from tidepool.llm.substring_dedup import NO_ID, _rolled

#: Words of a shingle and percent of similarity, unless a contract says otherwise.
SHINGLE, PERCENT = 5, 80
#: Counters of the frequency sketch, in so many segments; members of a block; text bytes of a chunk and of a hash range.
COUNTERS, SEGMENTS, BLOCK, CHUNK_TEXT, RANGE_TEXT = 1 << 20, 16, 768, 8 << 20, 24 << 20
#: Homes of several blocks up to which their list is broadcast (20 bytes each); beyond, it is joined by shuffling.
BROADCAST_HOMES = 100_000
#: Sketches that are added up in one group.
FAN_IN = 64

_SCAN = pa.schema([("segment", pa.int32()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("counters", pa.binary())])
_SCAN_DDL = "segment int, doc_id long, node long, n long, sketch binary, counters binary"
_MEMBER_DDL = "sig long, node long"
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: its distinct shingle hashes, sorted, and the bytes of each one's words."""
    words = words_of(texts, lower=True)
    h = words.hashes()
    bytes_ = pa.compute.binary_length(words.values).to_numpy(zero_copy_only=False).astype(np.int32)[words.codes] if len(h) else np.zeros(0, np.int32)
    whole = _rolled(h, size)
    ends = np.concatenate([[0], np.cumsum(bytes_)])
    for s, e in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if e - s >= size:
            u, at = np.unique(whole[s : e - size + 1], return_index=True)
            yield u, ends[s + at + size] - ends[s + at]
        elif e > s:
            yield _rolled(h[s:e], e - s), ends[e : e + 1] - ends[s]
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def node_of(u: np.ndarray) -> int:
    """A digest of a set; 0 never stands for one."""
    return (int(mix(u + GOLD).sum(dtype=np.uint64)) or 1) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Orders:
    """Three global orders of tokens."""

    def __init__(self, counters: np.ndarray):
        middle, high = np.quantile(counters, [0.5, 0.84])
        usual = 4 * max(float(high - middle), 1) + 4
        over = counters - float(middle)
        self.level = np.where(over <= usual, 0, np.minimum(1 + np.log2(np.maximum(over / usual, 1)), 15)).astype(np.uint64)

    @staticmethod
    def counter(u: np.ndarray) -> np.ndarray:
        return (mix(u) & np.uint64(COUNTERS - 1)).astype(np.int64)

    def first(self, u: np.ndarray, sizes: np.ndarray, p: int) -> np.ndarray:
        short = np.uint64(7) - np.minimum(sizes // 6, 7).astype(np.uint64)
        key = (self.level[self.counter(u)] << np.uint64(60)) | (short << np.uint64(57)) | (mix(u + np.uint64(1)) >> np.uint64(7))
        return u[np.argpartition(key, p - 1)[:p]]

    @staticmethod
    def other(u: np.ndarray, order: int, p: int) -> np.ndarray:
        key = mix(u + np.uint64(order * 0x9E37))
        return np.sort((key[np.argpartition(key, p - 1)[:p]] >> np.uint64(24)).astype(np.uint32))


def sketch_bits(percent: int) -> float:
    """Bits a token, 1 at most, of the small bitmaps: 4.5 times what linked sets of a size may differ in."""
    return min(1.0, 9 * (100 - percent) / (100 + percent))


def parity_bits(u: np.ndarray, each: float = 4) -> bytes:
    """A bitmap of a power of two of bits, at least ``each`` a token, in which each token flips one."""
    bits = 1 << max(6, (math.ceil(each * len(u)) - 1).bit_length())
    at = (mix(u + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _scanned(rows: DataFrame, shingle: int, percent: int = PERCENT) -> DataFrame:
    """Rows of two kinds: each document's set (segment -1), and each task's counters by segment (doc_id: the task's number)."""

    each = sketch_bits(percent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, dtype=np.int64)
        for b in chunks(batches, limit=CHUNK_TEXT):
            sets = [u for u, _ in shingle_sets(text_array(b), shingle)]
            counters += np.bincount(Orders.counter(np.concatenate(sets)), minlength=COUNTERS)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), b.column(0), pa.array([node_of(u) if len(u) else None for u in sets], pa.int64()), pa.array([len(u) for u in sets], pa.int64()), pa.array([parity_bits(u, each) if len(u) else None for u in sets], pa.binary()), pa.nulls(n, pa.binary())], schema=_SCAN)
        parts, task = counters.astype(np.uint32).reshape(SEGMENTS, -1), pa.array([TaskContext.get().partitionId()] * SEGMENTS, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), task, *(pa.nulls(SEGMENTS, pa.int64()) for _ in range(2)), pa.nulls(SEGMENTS, pa.binary()), pa.array([x.tobytes() for x in parts], pa.binary())], schema=_SCAN)

    return rows.mapInArrow(scan, _SCAN_DDL)


def _numbers(counters: bytes) -> np.ndarray:
    """A task's counters have four bytes each, sums have eight."""
    return np.frombuffer(counters, dtype=np.uint32 if len(counters) == 4 * COUNTERS // SEGMENTS else np.int64)


def _counters(scanned: DataFrame, tasks: int) -> np.ndarray:
    """All tasks' counters added up, ``FAN_IN`` at a time in a tree; COUNTERS numbers, however much text there is."""

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // SEGMENTS, dtype=np.int64)
        for x in rows.column("counters").to_pylist():
            total += _numbers(x)
        first = rows.slice(0, 1)
        return pa.table({"segment": first.column("segment"), "part": first.column("part"), "counters": pa.array([total.tobytes()], pa.binary())})

    some = scanned.filter("segment >= 0").select("segment", F.col("doc_id").alias("part"), "counters")
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        some = some.withColumn("part", F.floor(F.col("part") / F.lit(FAN_IN))).groupBy("segment", "part").applyInArrow(added, "segment int, part long, counters binary")
    out = np.zeros((SEGMENTS, COUNTERS // SEGMENTS), dtype=np.int64)
    for r in some.collect():  # one row per segment
        out[r["segment"]] = _numbers(bytes(r["counters"]))
    return out.reshape(-1)


def _groups(rows: DataFrame, counters: np.ndarray, buckets: int, shingle: int, percent: int) -> DataFrame:
    """sig, size, node: each distinct posting of at least two nodes under order 1, cut where set sizes are too far apart.

    A token is 32 bits beside its bucket; postings that so fall together only have more nodes.
    """
    orders = rows.sparkSession.sparkContext.broadcast(Orders(counters))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=CHUNK_TEXT):
            tokens, nodes, lengths = [], [], []
            seen: set[int] = set()
            for u, sizes in shingle_sets(text_array(b), shingle):
                if not len(u) or (node := node_of(u)) in seen:
                    continue
                seen.add(node)
                t = orders.value.first(u, sizes, prefix_length(len(u), percent))
                tokens.append(t)
                nodes.append(np.full(len(t), node, dtype=np.int64))
                lengths.append(np.full(len(t), len(u), dtype=np.uint32))
            if not tokens:
                continue
            token, node, n = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(lengths)
            where = (((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges)).tolist()
            cut = [pa.array([x[order][edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary()) for x in (token.astype(np.uint32), node, n)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *cut], names=["bucket", "token", "node", "n"])

    def grouped(rows: pa.Table) -> pa.Table:
        token, node, n = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=t) for c, t in (("token", np.uint32), ("node", np.int64), ("n", np.uint32)))
        order = np.lexsort((node, n, token))
        token, node, n = token[order], node[order], n[order].astype(np.int64)
        once = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])] if len(token) else np.zeros(0, bool)
        token, node, n = token[once], node[once], n[once]
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (percent * n[1:] > 100 * n[:-1])]) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(token)])
        sig = mix(np.add.reduceat(mix(node.view(np.uint64)), first) + size.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
        _, kept = np.unique(sig, return_index=True)
        kept = kept[size[kept] > 1]
        index = np.concatenate([np.arange(first[k], first[k] + size[k]) for k in kept.tolist()]) if len(kept) else np.zeros(0, np.int64)
        return pa.table({"sig": pa.array(np.repeat(sig[kept], size[kept]).view(np.int64)), "size": pa.array(np.repeat(size[kept], size[kept])), "node": pa.array(node[index])})

    return rows.mapInArrow(posted, "bucket int, token binary, node binary, n binary").groupBy("bucket").applyInArrow(grouped, "sig long, size long, node long").distinct()


def _reread(rows: DataFrame, wanted: DataFrame, shingle: int, made: Callable[[np.ndarray], tuple], ddl: str, schema: pa.Schema) -> DataFrame:
    """node and what ``made`` makes of its set, for the nodes (node, rep) wanted; a sieve of ids thins the documents first."""
    sieve = rows.sparkSession.sparkContext.broadcast(Sieve.of(wanted, "rep"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = (b.filter(pa.array(sieve.value.test(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))) for b in batches)
        for b in chunks(near, limit=CHUNK_TEXT):
            out = [(node_of(u), *made(u)) for u, _ in shingle_sets(text_array(b), shingle) if len(u)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], schema.field(k).type) for k in range(len(schema))], schema=schema)

    return rows.mapInArrow(read, ddl).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


class Bitmaps:
    """Rows sorted by set size, with parity bitmaps to rule pairs out by: members of a group, residents and visitors."""

    def __init__(self, rows: list[tuple], n: int, visitor: int, bits: int, percent: int):
        self.rows, self.percent = sorted(rows, key=lambda r: (r[n], r[0])), percent
        self.n = np.array([r[n] for r in self.rows], dtype=np.int64)
        self.visitor = np.array([r[visitor] for r in self.rows], dtype=bool)
        self.bits = [r[bits] for r in self.rows]
        self.sizes = sorted({len(x) for x in self.bits})
        self.matrices: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def largest(self, i: int) -> int:
        """Bytes of the largest bitmap that a partner of the i-th may have: a set of 100 / percent as many tokens, rounded up twice."""
        return 2 * len(self.bits[i]) * -(-100 // self.percent)

    def matrix(self, size: int, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, their bitmaps) of those with ``size`` bytes, folded to ``fold`` bytes."""
        if (size, fold) not in self.matrices:
            at = np.array([i for i, x in enumerate(self.bits) if len(x) == size], dtype=np.int64)
            m = np.frombuffer(b"".join(self.bits[i] for i in at.tolist()), dtype=np.uint64).reshape(len(at), size // 8)
            while m.shape[1] * 8 > fold:
                m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
            self.matrices[size, fold] = (at, m)
        return self.matrices[size, fold]

    def last(self, i: int) -> int:
        """Members up to here aren't too large for the i-th."""
        return int(np.searchsorted(self.n, 100 * self.n[i] // self.percent, side="right"))

    def near(self, i: int, last: int, apart: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Later members, among those ``apart`` keeps and not visitors both, that bitmaps don't rule out."""
        own, out = len(self.bits[i]), []
        mine = np.frombuffer(self.bits[i], dtype=np.uint64)
        for size in self.sizes:
            if size < own or size > self.largest(i):
                continue
            at, m = self.matrix(size, own)
            lo, hi = np.searchsorted(at, [i + 1, last])
            keep = apart(at[lo:hi]) & ~(self.visitor[at[lo:hi]] & self.visitor[i])
            if keep.any():
                at = at[lo:hi][keep]
                differ = np.bitwise_count(m[lo:hi][keep] ^ mine).sum(axis=1).astype(np.int64)
                out.append(at[(100 + self.percent) * differ <= (100 - self.percent) * (self.n[at] + self.n[i])])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def with_partner(self) -> list[tuple]:
        """The rows that some other row of the group may be linked with."""
        hit = np.zeros(len(self.rows), dtype=bool)
        for i in range(len(self.rows) - 1):
            if (last := self.last(i)) > i + 1 and len(at := self.near(i, last, lambda at: np.ones(len(at), dtype=bool))):
                hit[i] = hit[at] = True
        return [r for r, h in zip(self.rows, hit.tolist(), strict=True) if h]


class Group(Bitmaps):
    """Members as rows (node, n, comp, visitor, p2, p3, bits, tokens, failed), and the pairs that would join components."""

    def __init__(self, rows: list[tuple], percent: int):
        super().__init__(rows, 1, 3, 6, percent)
        names: dict[int, int] = {}
        self.comp = np.array([names.setdefault(r[2], len(names)) for r in self.rows], dtype=np.int64)

    def pairs(self) -> list[tuple[int, int]]:
        out = []
        for i in range(len(self.rows) - 1):
            last = self.last(i)
            if last <= i + 1 or (self.comp[i + 1 : last] == self.comp[i]).all():
                continue
            for j in self.near(i, last, lambda at, i=i: self.comp[at] != self.comp[i]).tolist():
                if self.comp[j] != self.comp[i] and self.alike(i, j):
                    out.append((self.rows[i][0], self.rows[j][0]))
                    self.comp[self.comp == self.comp[j]] = self.comp[i]
        return out

    def alike(self, i: int, j: int) -> bool:
        """Not known to fail, sharing prefix tokens under the other orders as well, and enough short tokens."""
        a, b = self.rows[i], self.rows[j]
        if b[0] in a[8] or a[0] in b[8] or not all(_common(a[k], b[k]) for k in (4, 5)):
            return False
        common = _common(a[7], b[7])
        return 100 * common >= self.percent * (a[1] + b[1] - common)


def _common(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _worth_comparing(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The members (sig, node) of postings (sig, size, node) that small bitmaps leave some partner in the posting.

    These bitmaps are a fiftieth of what the full comparison needs, and rule out nodes that share a token by chance or
    in a common passage. Of postings larger than a block, all members stay.
    """

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> list[tuple]:
            return [(key, r[0]) for r in Bitmaps(rows, 1, 3, 2, percent).with_partner()] if len(rows) > 1 else []

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["sig", "node"])

        for b in batches:
            out: list[tuple] = []
            for sig, node, n, sketch in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sig != key:
                    out += done()
                    key, rows = sig, []
                rows.append((node, n, sketch, False))
            if out:
                yield batch(out)
        if out := done():
            yield batch(out)

    small = members.filter(F.col("size") <= BLOCK).join(nodes.select("node", "n", "sketch"), "node").select("sig", "node", "n", "sketch")
    near = small.repartition("sig").sortWithinPartitions("sig").mapInArrow(thinned, _MEMBER_DDL)
    return near.unionByName(members.filter(F.col("size") > BLOCK).select("sig", "node"))


def _candidates(keyed: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs to verify. ``keyed``: home, i, j, node, comp, visitor, failed; compared within (home, i, j)."""
    columns = ["home", "i", "j", "node", "n", "comp", "visitor", "p2", "p3", "bits", "tokens", "failed"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> list[tuple[int, int]]:
            return Group(rows, percent).pairs() if len(rows) > 1 and not all(r[3] for r in rows) else []

        for b in batches:
            out: list[tuple[int, int]] = []
            for *k, node, n, comp, visitor, p2, p3, bits, tokens, failed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    out += done()
                    key, rows = k, []
                rows.append((node, n, comp, visitor, p2, p3, bits, tokens, failed or ()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=_PAIR)
        if out := done():
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=_PAIR)

    dealt = keyed.join(profiles, "node").select(*columns).repartition("home", "i", "j").sortWithinPartitions("home", "i", "j")
    pairs = dealt.mapInArrow(compared, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(rows: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b, linked: the exact test of each pair."""
    used = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node"))
    sets = _reread(rows, used, shingle, lambda u: (u.tobytes(),), "node long, items binary", pa.schema([("node", pa.int64()), ("items", pa.binary())]))

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tested, "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node of the edges (a, b) reaches, by large-star and small-star steps."""
    edges, last = staged(edges.select("a", "b").filter("a <> b").distinct()), None
    while True:
        start = edges
        # large star: every node's larger neighbours move to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours, and itself, move to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        edges = staged(moved.filter("a <> b").distinct())
        unstage(start)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def _homes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """residents (node, home, block, blocks, leader), and visits (node, home) to larger homes of nodes in a common posting."""
    sizes = members.groupBy("sig").agg(F.count("*").alias("size"))
    sized = members.join(sizes, "sig")
    home = sized.groupBy("node").agg(F.max(F.struct("size", "sig")).alias("h")).select("node", F.col("h.sig").alias("home"), F.col("h.size").alias("rank"))
    home = staged(home)
    # few homes have several blocks: only what these need is brought to their residents
    large = home.groupBy("home").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter(F.col("n") > BLOCK)
    large = staged(large.select("home", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"), "leader"))
    large = F.broadcast(large) if large.count() <= BROADCAST_HOMES else large
    blocks = F.coalesce("blocks", F.lit(1))
    residents = staged(home.join(large, "home", "left").select("node", "home", blocks.alias("blocks"), "leader", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")))
    named = staged(members.join(home, "node"))
    hosts = named.select("sig", F.col("home").alias("host"), F.col("rank").alias("host_rank")).distinct()
    mixed = hosts.groupBy("sig").count().filter("count > 1").select("sig")
    met = named.join(mixed, "sig").join(hosts, "sig").filter(F.struct("host_rank", "host") > F.struct("rank", "home"))
    return residents, staged(met.select("node", F.col("host").alias("home")).distinct())


def _strays(residents: DataFrame) -> DataFrame:
    """Homes that are not yet one component, dealt out for comparing: home, i, j, node, comp, visitor, failed.

    Members of a home's largest component need no comparing with each other. The others, its strays, are cut in blocks, and
    each block meets all members but the strays of blocks behind it, as visitors. A home with few strays so stays linear.
    """
    main = residents.groupBy("home", "comp").agg(F.count("*").alias("n")).groupBy("home").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    open_ = staged(main.filter(F.col("all") > F.col("most")).select("home", "main", F.ceil((F.col("all") - F.col("most")) / F.lit(BLOCK)).cast("int").alias("cuts")))
    open_ = F.broadcast(open_) if open_.count() <= BROADCAST_HOMES else open_
    own = F.when(F.col("comp") != F.col("main"), F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    met = residents.join(open_, "home").withColumn("own", own).withColumn("i", F.explode(F.sequence(F.coalesce("own", F.lit(0)), F.col("cuts") - 1)))
    return met.withColumn("visitor", ~F.col("i").eqNullSafe(F.col("own"))).withColumn("j", F.col("i"))


class Links:
    """The verified links so far, the components they make, and the pairs that failed."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, shingle: int, percent: int):
        self.args = (rows, nodes, shingle, percent)
        self.links: DataFrame | None = None
        self.failed: DataFrame | None = None
        self.labels: DataFrame | None = None

    def labelled(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` with comp and failed."""
        if self.labels is None:
            out = keyed.withColumn("comp", F.col("node"))
        else:
            out = keyed.join(self.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if self.failed is None:
            return out.withColumn("failed", F.lit(None).cast("array<long>"))
        return out.join(self.failed.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("failed")), "node", "left")

    def add(self, pairs: DataFrame) -> bool:
        """Verify pairs; whether any failed, so that others may have to be tried."""
        rows, nodes, shingle, percent = self.args
        pairs = staged(pairs)
        if not pairs.take(1):
            return False
        tested = staged(_verified(rows, pairs, nodes, shingle, percent))
        linked, missed = tested.filter("linked").select("a", "b"), tested.filter("not linked").select("a", "b")
        self.links = linked if self.links is None else self.links.unionByName(linked)
        if linked.take(1) or self.labels is None:
            self.labels = staged(components(self.links))
        if not missed.take(1):
            return False
        self.failed = missed if self.failed is None else self.failed.unionByName(missed)
        return True


def join_components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach from each document."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
    rows = only(documents, doc_id="doc_id", text="text").select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scanned = staged(_scanned(rows, shingle, percent))
    sets = scanned.filter("segment = -1").select("doc_id", "node", "n")
    tasks = 1 + (scanned.filter("segment = 0").agg(F.max("doc_id")).first()[0] or 0)
    nodes = staged(scanned.filter("segment = -1 and n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("sketch").alias("sketch")))
    postings = staged(_groups(rows, _counters(scanned, tasks), buckets_for(text_bytes(rows), RANGE_TEXT, 4), shingle, percent))
    members = staged(_worth_comparing(postings, nodes, percent))
    unstage(postings)
    residents, visits = _homes(members)
    unstage(members)

    profile_schema = pa.schema([("node", pa.int64()), ("p2", pa.binary()), ("p3", pa.binary()), ("bits", pa.binary()), ("tokens", pa.binary())])
    met = staged(residents.select("node").join(nodes.select("node", "rep", "n"), "node"))

    def profiled(u: np.ndarray) -> tuple:
        p = prefix_length(len(u), percent)
        short = np.sort((mix(u + np.uint64(5)) >> np.uint64(32)).astype(np.uint32))
        return Orders.other(u, 2, p).tobytes(), Orders.other(u, 3, p).tobytes(), parity_bits(u), short.tobytes()

    profiles = staged(_reread(rows, met, shingle, profiled, "node long, p2 binary, p3 binary, bits binary, tokens binary", profile_schema).join(met.select("node", "n"), "node"))

    found = Links(rows, nodes, shingle, percent)
    largest = residents.agg(F.max("blocks")).first()[0] or 1
    every = F.when(F.col("node").eqNullSafe(F.col("leader")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    alone = residents.withColumn("i", F.explode(every)).withColumn("j", F.col("i")).withColumn("visitor", F.lit(False))
    missed = found.add(_candidates(found.labelled(alone), profiles, percent))
    while missed or largest > 1:
        missed, largest = found.add(_candidates(_strays(found.labelled(residents)), profiles, percent)), 1
    # homes with their visitors; a home without any is settled
    own = residents.join(visits.select("home").distinct(), "home", "left_semi").select("home", "node", "block", F.lit(False).alias("visitor"))
    guests = visits.join(residents.select("home", "blocks").distinct(), "home").select("home", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visitor"))
    met_there = staged(own.unionByName(guests))
    both = met_there.withColumn("i", F.col("block")).withColumn("j", F.col("block"))
    while found.add(_candidates(found.labelled(both), profiles, percent)):
        pass
    labels = found.labels if found.labels is not None else nodes.select("node", F.col("node").alias("comp"))

    named = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = named.groupBy("comp").agg(F.min("rep").alias("id"))
    named = staged(named.join(ids, "comp").select("node", "id"))
    unstage(nodes, residents, visits, met, profiles, met_there)
    out = sets.join(named, "node", "left")
    own = F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("doc_id"))
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(own).alias("component_id"))


def keep_one(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the smallest id (null before all; then the smallest hash), and no repeats of one id and text.

    Rows are told apart by id and a 64-bit hash of id and text, so a row is never removed for what others with its id are linked to.
    """
    names = {c.lower(): c for c in documents.columns}
    doc_id, text = (F.col(f"`{names[c]}`") for c in ("doc_id", "text"))
    own = doc_id.cast("long")
    # the row is carried as one struct, so that no name of its columns clashes
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"), own.alias("own"), F.xxhash64(text, own).alias("key"), text.cast("string").alias("text"))
    joined = join_components(rows.select(F.col("key").alias("doc_id"), "text"), shingle, percent)
    found = staged(joined)
    unstage(joined)
    linked = found.filter("doc_id <> component_id").select("doc_id", "component_id")
    members = staged(linked.unionByName(linked.select(F.col("component_id").alias("doc_id"), "component_id")).distinct())
    named = rows.filter(maybe_among(members, "doc_id")(F.col("key"))).select("key", "own").distinct()
    named = staged(named.join(members, F.col("key") == F.col("doc_id")).select("key", "own", "component_id"))
    stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNotNull().alias("known"), "own", "key")).alias("x")).select("x.key")
    gone = staged(named.join(stays, "key", "left_anti").select(F.col("key").alias("gone_key"), F.col("own").alias("gone_own")))
    hit = maybe_among(gone, "gone_key")(F.col("key"))
    held = rows.filter(hit).join(gone, (F.col("key") == F.col("gone_key")) & F.col("own").eqNullSafe(F.col("gone_own")), "left_anti")
    out = rows.filter(~hit).unionByName(held)
    if found.groupBy("doc_id").count().filter("count > 1").take(1):
        out = out.dropDuplicates(["own", "text"])
    unstage(found, members, named)
    return out.select(*[F.col("whole").getField(c).alias(c) for c in documents.columns])
