"""Document fingerprints by a randomised edit embedding.

A walk shared by all texts reads the characters in turn: at output step t with character c, a shared random bit r(t, c)
says whether the walk moves on to the next character or repeats it. After an edit, two walks fall into step again, so
the embedded strings differ in about as many places as the texts have edits: edit distance becomes Hamming distance.

The embedded string is sampled, not stored: the first ``SAMPLES`` steps and as many of every octave [2**k, 2**(k+1)) *
SAMPLES are kept, as one hex digit each (a hash of the character there). A longer text so has more digits, early steps are at the same place in every
fingerprint, and an octave's share of agreeing digits stands for its share of the string. The likeness of two
fingerprints weighs octaves by their length.

All walks of a chunk run side by side in numpy, one character of each text per round. ``near_pairs`` and ``near_classes``
sample bits of the digits for bands, put equal bands in buckets and verify candidates by their likeness.

Documents are in order of (doc_id, a hash of the text), so repeated rows follow one another. They are dealt out in ranges of
this order, as many as the text needs; the ends of ranges meet in a join of one row a range.

Nulls: a null text is empty and has the empty fingerprint; a null doc_id sorts last. The only row is its own next document.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import GOLD, Sieve, buckets_for, chunks, give_back, hash_strings, maybe_among, mix, only, staged, text_bytes
from tidepool.llm.jaccard_join import components

SAMPLES, CLASSES, PERIOD = 24, 256, 4096
#: Characters per round of walking, text bytes of a range of documents and of a chunk; steps whose samples are counted by table.
ROUND, RANGE_TEXT, CHUNK_TEXT, TABLE = 128, 16 << 20, 6 << 20, 1 << 20
#: Fingerprints of a band's bucket that are compared with as many others at a time; bytes of fingerprints of a hash range of bands.
BLOCK, RANGE_PRINTS = 2048, 4 << 20
#: Octaves after the first steps, as many as Walk samples.
MOST_OCTAVES = 36
#: The likeness from which texts are near, and the share of pairs just there that bands must bring together.
LEAST, RECALL = 0.7, 0.95
#: Digits of a piece of a short fingerprint, and the lengths of fingerprints that are cut so. Of two whose likeness is 0.7 at
#: least, the shorter one of n < SAMPLES digits, the longer one has at most n / 0.71875 digits, and of the first n at most
#: n - 0.71875 n differ: fewer than there are whole pieces, of two digits for n under 12 (one if n = 1), of three from there on.
PIECES = {1: (1, 3), 2: (2, 15), 3: (12, 33)}

_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RANGED = pa.schema([*_OUT, ("span", pa.int32()), ("end", pa.int32()), ("bytes", pa.int64()), ("z", pa.binary())])
_RANGED_DDL = f"{OUT_DDL}, span int, end int, bytes long, z binary"


class Walk:
    """The shared randomness: how many steps each (class, step) stays, and which steps are sampled."""

    def __init__(self, seed: int = 8):
        r = np.random.Generator(np.random.Philox(seed))
        moves = r.random((CLASSES, PERIOD)) < 0.5
        stay = np.zeros((CLASSES, PERIOD), dtype=np.uint8)
        ahead = np.full(CLASSES, 8, dtype=np.uint8)
        for t in range(2 * PERIOD - 1, -1, -1):  # steps from t to the first that moves on, itself included; at most 8
            ahead = np.where(moves[:, t % PERIOD], 1, np.minimum(ahead + 1, 8)).astype(np.uint8)
            if t < PERIOD:
                stay[:, t] = ahead
        self.stay = stay.reshape(-1)
        self.digit = r.integers(0, 16, size=CLASSES).astype(np.uint8)
        steps = [np.arange(SAMPLES)]
        for k in range(MOST_OCTAVES):
            steps.append(np.sort(((1 + r.random(SAMPLES)) * (SAMPLES << k)).astype(np.int64)))
        self.samples = np.concatenate(steps)
        self.count = np.searchsorted(self.samples, np.arange(TABLE)).astype(np.int16)

    def reached(self, step: np.ndarray) -> np.ndarray:
        """How many sampled steps lie before each step."""
        if int(step.max(initial=0)) < TABLE:
            return self.count.take(step)
        return np.searchsorted(self.samples, step).astype(np.int16)

    def classes(self, points: np.ndarray) -> np.ndarray:
        p = points.astype(np.uint32)
        return (((p * np.uint32(0x9E3779B1)) >> np.uint32(15)) & np.uint32(CLASSES - 1)).astype(np.int32)


def likeness(a: str, b: str) -> float:
    """0 to 1: the agreeing share of two embedded strings, from their sampled digits; 1 for equal ones."""
    if a == b:
        return 1.0
    n, m = max(len(a), len(b)), min(len(a), len(b))
    octave = np.arange(n) // SAMPLES
    weight = 2.0 ** np.maximum(octave - 1, 0)
    same = float(weight[:m][np.frombuffer(a[:m].encode(), np.uint8) == np.frombuffer(b[:m].encode(), np.uint8)].sum())
    total = float(weight.sum())
    # digits agree by chance one time in 16
    return max(0.0, (same / total - 1 / 16) / (1 - 1 / 16)) if total else 0.0


def digit_rows(prints: list[str], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, matrix): the digits of each fingerprint, one row each, filled up."""
    size = np.array([len(x) for x in prints], dtype=np.int64)
    rows = np.full((len(size), int(size.max(initial=0))), fill, dtype=np.uint8)
    rows[np.arange(rows.shape[1]) < size[:, None]] = np.frombuffer("".join(prints).encode(), np.uint8)
    return size, rows


def weights(n: int) -> np.ndarray:
    """How many steps of the walk each of the first digits stands for."""
    return 2.0 ** np.maximum(np.arange(n) // SAMPLES - 1, 0)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """likeness() of many pairs."""
    out = np.empty(len(a))
    for s in range(0, len(a), 4096):
        (n, x), (m, y) = digit_rows(a[s : s + 4096], 1), digit_rows(b[s : s + 4096], 2)
        wide = max(x.shape[1], y.shape[1])
        w = weights(wide)
        upto = np.concatenate([[0.0], np.cumsum(w)])
        k = min(x.shape[1], y.shape[1])
        same, total = (x[:, :k] == y[:, :k]) @ w[:k], upto[np.maximum(n, m)]
        share = np.divide(same, total, out=np.ones(len(total)), where=total > 0)
        out[s : s + 4096] = np.where(share == 1, 1.0, np.maximum(0.0, (share - 1 / 16) / (1 - 1 / 16)))
    return out


def fingerprints(walk: Walk, points: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint of each text, given all code points and the texts' offsets; one digit per sampled step it reaches."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    size, start = sizes[order], offsets[:-1][order]
    shifted = walk.classes(points) * PERIOD
    step = np.zeros(len(order), dtype=np.int64)
    digits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    longest = int(size[0]) if len(size) else 0
    for first in range(0, longest, ROUND):
        active = int(np.searchsorted(-size, -first, side="left"))
        span = min(ROUND, longest - first)
        index = start[:active] + first + np.arange(span)[:, None]
        np.minimum(index, len(shifted) - 1, out=index)
        cells = shifted[index]
        now = step[:active].copy()
        path = np.empty((span + 1, active), dtype=np.int64)
        path[0] = now
        left = size[:active] - first
        full = int(np.searchsorted(-left, -span, side="right"))  # texts that last the whole round
        for i in range(span):
            live = active if i == 0 else full if i >= span - 1 else int(np.searchsorted(-left, -i, side="left"))
            at = (now[:live] & (PERIOD - 1)) + cells[i, :live]
            now[:live] += walk.stay.take(at)
            path[i + 1] = now
        # two reads of a round's ends tell which texts pass a sampled step at all
        some = np.flatnonzero(walk.reached(path[-1]) > walk.reached(path[0]))
        if len(some):
            reached = walk.reached(path[:, some])
            i, j = np.nonzero(reached[1:] > reached[:-1])
            n = (reached[i + 1, j] - reached[i, j]).astype(np.int64)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            j = some[j]
            digits.append((np.repeat(order[j], n), np.repeat(reached[i, np.searchsorted(some, j)].astype(np.int64), n) + nth, np.repeat(walk.digit[cells[i, j] // PERIOD], n)))
        step[:active] = now
    out = [""] * len(order)
    if not digits:
        return out
    text, place, digit = (np.concatenate([d[k] for d in digits]) for k in range(3))
    by = np.lexsort((place, text))
    text, digit = text[by], digit[by]
    hexed = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)[digit].tobytes().decode()
    edges = np.searchsorted(text, np.arange(len(order) + 1)).tolist()
    return [hexed[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return joined, offsets


def edited(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by the first as many of the following document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_edited(documents: DataFrame, range_text: int = RANGE_TEXT) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows = only(documents, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.encode() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in raw], pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())], names=["doc_id", "h", "bytes", "z"])

    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    small = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(packed, "doc_id long, h long, bytes long, z binary")
    ranged = small.repartitionByRange(buckets_for(text_bytes(rows), range_text), *order).sortWithinPartitions(*order)

    def text_of(z: bytes, size: int) -> str:
        return pa.decompress(z, size, "zstd", asbytes=True).decode() if size else ""

    def done(walk: Walk, ids: list, texts: list[str], real: int) -> list[pa.Array]:
        """The first ``real`` texts, each of which has its next one in the list."""
        changed = [edited(a, b) for a, b in zip(texts[:real], texts[1 : real + 1], strict=True)]
        prints = fingerprints(walk, *_points(texts[: real + 1] + changed))
        own, later = prints[: real + 1], prints[real + 1 :]
        return [pa.array(ids[:real], pa.int64()), pa.array([len(x) for x in texts[:real]], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]), pa.array(own[:real]), pa.array(later), pa.array(likenesses(own[:real], later)), pa.array(likenesses(own[:real], own[1:]))]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, span = Walk(), TaskContext.get().partitionId()
        ids, texts, held, last = [], [], 0, None  # rows that wait for their next one

        def batch(found: list[pa.Array]) -> pa.RecordBatch:
            n = len(found[0])
            return pa.RecordBatch.from_arrays([*found, pa.array([span] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_RANGED)

        def edge(end: int, doc_id: int | None, size: int, z: bytes) -> pa.RecordBatch:
            """The first (1) or last (2) row of the range, which waits for the range beside it."""
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.nulls(1, f.type) for f in list(_OUT)[1:]), pa.array([span], pa.int32()), pa.array([end], pa.int32()), pa.array([size], pa.int64()), pa.array([z], pa.binary())], schema=_RANGED)

        for b in batches:
            for i, size, z in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if last is None:
                    yield edge(1, i, size, z)
                last = (i, size, z)
                ids.append(i)
                texts.append(text_of(z, size))
                held += size
                if held >= CHUNK_TEXT and len(texts) > 1:
                    yield batch(done(walk, ids, texts, len(texts) - 1))
                    ids, texts, held = ids[-1:], texts[-1:], size
                    give_back()
        if len(texts) > 1:
            yield batch(done(walk, ids, texts, len(texts) - 1))
        if last is not None:
            yield edge(2, *last)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk()
        for b in batches:
            for i, *own in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                yield pa.RecordBatch.from_arrays(done(walk, [i], [text_of(own[1], own[0]), text_of(own[3], own[2])], 1), schema=_OUT)

    found = staged(ranged.mapInArrow(walked, _RANGED_DDL))
    firsts = found.filter("end = 1").select(F.col("span").alias("of"), F.col("bytes").alias("next_bytes"), F.col("z").alias("next_z"))
    spans = sorted(r["of"] for r in firsts.select("of").collect())  # a number per range
    after = documents.sparkSession.createDataFrame(list(zip(spans, spans[1:] + spans[:1], strict=True)), "span int, of int")
    pairs = found.filter("end = 2").select("span", "doc_id", "bytes", "z").join(after, "span").join(firsts, "of").select("doc_id", "bytes", "z", "next_bytes", "next_z")
    return found.filter("end = 0").select(_OUT.names).unionByName(pairs.mapInArrow(joined, OUT_DDL))


def _links(fingerprints: list[str], comps: list[int], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """i, j, likeness: alike pairs of one from each side (a side may be both) that join components not yet joined."""
    size, rows = digit_rows(fingerprints)
    weight = weights(rows.shape[1])
    upto = np.concatenate([[0.0], np.cumsum(weight)])
    comp, apart, out = np.array(comps), ~np.isin(right, left), []
    for i in left.tolist():
        others = right[(right > i) | apart]
        others = others[comp[others] != comp[i]]
        if len(others):
            n = int(size[i])
            same = (rows[others, :n] == rows[i, :n]) @ weight[:n]
            like = np.maximum(0.0, (same / upto[np.maximum(size[others], n)] - 1 / 16) / (1 - 1 / 16))
            found = np.flatnonzero(like >= least)
            out += [(i, int(others[k]), float(like[k])) for k in found.tolist()]
            comp[np.isin(comp, comp[others[found]])] = comp[i]
    return out


def band_shape(n: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """(bands, digits of a band) for n fingerprints: digits so that unlike ones seldom meet, bands so that alike ones do.

    Digits of unrelated texts agree about one time in ten, so with a digit more than n has, a fingerprint meets a stranger
    in a few bands at most, however many there are. A band of alike ones agrees with the agreeing share to the power of its digits.
    """
    digits = max(6, 1 + math.ceil(math.log10(max(n, 1))))
    agree = (1 / 16 + least * 15 / 16) ** digits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))), digits


class Bands:
    """Bit sampling by weight: each sample of a fingerprint is one digit, with the chance of its weight among all it has.

    Every sample gives each place an exponential number over the place's weight, shared by all; a fingerprint's digit is the
    one of its place with the least number. So two fingerprints have the same place and digit with a chance of just
    the agreeing share of their weights, also where their lengths differ. A band is a hash of several samples.
    """

    def __init__(self, bands: int, digits: int, seed: int = 80):
        r = np.random.Generator(np.random.Philox(seed))
        places = SAMPLES * (1 + MOST_OCTAVES)
        race = r.exponential(size=(bands * digits, places)) / weights(places)
        won = np.minimum.accumulate(race, axis=1) == race
        self.pick = np.zeros((bands * digits, places + 1), dtype=np.int16)
        self.pick[:, 1:] = np.maximum.accumulate(np.where(won, np.arange(places), 0), axis=1)
        self.factors = r.integers(1, 1 << 62, size=digits, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLD)
        self.shape = (bands, digits)

    def of(self, prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the fingerprint, hash of a band) of all bands; empty fingerprints have none."""
        size, rows = digit_rows(prints)
        at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            place = self.pick[:, n].astype(np.int64)
            value = (rows[own][:, place].astype(np.uint64) + place.astype(np.uint64) * np.uint64(256)).reshape(len(own), *self.shape)
            h = mix((value * self.factors).sum(axis=2, dtype=np.uint64) + self.salts)
            at.append(np.repeat(own, self.shape[0]))
            hashes.append(h.reshape(-1))
        extra = [(i, f"{width}/{k}:{x[k : k + width]}") for i, x in enumerate(prints) for width, (shortest, longest) in PIECES.items() if shortest <= len(x) <= longest for k in range(0, min(len(x), SAMPLES) - width + 1, width)]
        at.append(np.array([i for i, _ in extra], dtype=np.int64))
        hashes.append(hash_strings(pa.array([x for _, x in extra], pa.string())))
        return np.concatenate(at), np.concatenate(hashes)


def _repeated_bands(classes: DataFrame, bands: Bands, ranges: int) -> DataFrame:
    """h: band hashes that two fingerprints have; dealt out as packed arrays, without the fingerprints."""
    known = classes.sparkSession.sparkContext.broadcast(bands)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, column="fingerprint", limit=2 << 20):
            _, h = known.value.of(b.column(1).to_pylist())
            h, n = np.unique(h, return_counts=True)
            edges = np.searchsorted(((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(edges)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary()) for x in (h, n > 1))], names=["range", "h", "many"])

    def twice(rows: pa.Table) -> pa.Table:
        h, many = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=t) for c, t in (("h", np.uint64), ("many", bool)))
        values, at, n = np.unique(h, return_inverse=True, return_counts=True)
        keep = n > 1
        keep[at[many]] = True
        return pa.table({"h": pa.array(values[keep].view(np.int64))})

    return classes.select("node", "fingerprint").mapInArrow(met, "range int, h binary, many binary").groupBy("range").applyInArrow(twice, "h long")


def _near_links(prints: DataFrame, least: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """classes (fingerprint, doc_id, copies, node), links (a, b, likeness) between nodes, and the components of nodes (node, comp).

    Within a band's bucket every member is verified against one of them; then all that are not yet in one component against
    each other, in pairs of blocks. So a bucket of alike members never makes all of its pairs, and no link that joins
    components is lost: of two that share a band and are alike, each is reached from the other.
    """
    given = prints.select("doc_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    classes = staged(given.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    n, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.length("fingerprint")), F.lit(0))).first()
    bands = Bands(*band_shape(n, least, recall))
    sieve = Sieve.of(staged(_repeated_bands(classes, bands, buckets_for(size, RANGE_PRINTS, 4))), "h")
    known = prints.sparkSession.sparkContext.broadcast((bands, sieve))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, test = known.value
        for b in chunks(batches, column="fingerprint", limit=2 << 20):
            at, h = own.of(b.column(1).to_pylist())
            keep = test.test(h)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[keep])), pa.array(h[keep].view(np.int64))], names=["node", "band"])

    banded = staged(classes.select("node", "fingerprint").mapInArrow(shared, "node long, band long").distinct())
    heads = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a < most").select("band", "a")
    banded = staged(banded.join(heads, "band"))
    prints_of = lambda c: classes.select(F.col("node").alias(c), F.col("fingerprint").alias(f"{c}_print"))
    found = banded.filter("node <> a").select("a", F.col("node").alias("b")).distinct().join(prints_of("a"), "a").join(prints_of("b"), "b")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = likenesses(b.column(2).to_pylist(), b.column(3).to_pylist())
            keep = pa.array(like >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(like[like >= least])], names=["a", "b", "likeness"])

    links = staged(found.select("a", "b", "a_print", "b_print").mapInArrow(tested, "a long, b long, likeness double"))

    # buckets that are not yet one component: all of their members against each other
    labelled = staged(banded.select("band", "node").join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    open_ = labelled.groupBy("band").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi and n > 2")
    open_ = open_.select("band", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = labelled.join(open_, "band").join(classes.select("node", "fingerprint"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "fingerprint")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def pairs() -> list[tuple[int, int, float]]:
            if len(rows) < 2:
                return []
            block = np.array([r[0] for r in rows])
            left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            return [(rows[i][1], rows[j][1], x) for i, j, x in _links([r[3] for r in rows], [r[2] for r in rows], left, right, least)]

        for b in batches:
            out: list[tuple[int, int, float]] = []
            for *k, own, node, comp, digits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    out += pairs()
                    key, rows = k, []
                rows.append((own, node, comp, digits))
            yield _pair_batch(out)
        yield _pair_batch(pairs())

    rest = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(compared, "a long, b long, likeness double")
    both = staged(links.unionByName(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness").dropDuplicates(["a", "b"]))
    return classes, both, components(both)


def _pair_batch(pairs: list[tuple[int, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "likeness"])


def near_pairs(prints: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """a, b, likeness: links between fingerprints (columns doc_id, fingerprint) that share a band of sampled digits and are alike.

    Equal fingerprints are one class, named by its smallest doc_id; the class is linked to each of its other doc_ids, with
    likeness 1. Pairs that join nothing further are not all listed. Short fingerprints are also cut in ``PIECES``, so that
    all pairs with one of under an octave are found. A null doc_id is always b.
    """
    classes, links, _ = _near_links(prints, least, recall)
    name = lambda c: classes.select(F.col("node").alias(c), F.col("doc_id").alias(f"{c}_id"))
    pairs = links.join(name("a"), "a").join(name("b"), "b").select("a_id", "b_id", "likeness")
    given = prints.select("doc_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint")).distinct()
    equal = given.join(classes.select("fingerprint", F.col("doc_id").alias("a_id")), "fingerprint").select("a_id", F.col("doc_id").alias("b_id"), F.lit(1.0).alias("likeness"))
    out = pairs.unionByName(equal).filter(~F.col("a_id").eqNullSafe(F.col("b_id")))
    return out.select(F.least("a_id", "b_id").alias("a"), F.when(F.col("a_id").isNotNull() & F.col("b_id").isNotNull(), F.greatest("a_id", "b_id")).alias("b"), "likeness")


def near_classes(compared: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """``compared`` (doc_id, fingerprint and further columns) with near_class: the smallest doc_id that near links reach.

    Null where that is an own null id; a class with any id is named by one. Empty fingerprints are near only to each other.
    """
    classes, _, comps = _near_links(compared, least, recall)
    # most documents are alone in their class, and stay where they are
    named = classes.join(comps, "node", "left").filter("comp is not null or copies > 1").withColumn("comp", F.coalesce("comp", "node"))
    ids = named.groupBy("comp").agg(F.min("doc_id").alias("near_class"))
    shared = staged(named.join(ids, "comp").select(F.col("fingerprint").alias("class_print"), F.xxhash64("fingerprint").alias("class_hash"), "near_class"))
    hit = maybe_among(shared, "class_hash")(F.xxhash64("fingerprint"))
    far = compared.filter(~hit).withColumn("near_class", F.col("doc_id"))
    near = compared.filter(hit).join(shared, F.col("fingerprint") == F.col("class_print"), "left")
    near = near.withColumn("near_class", F.when(F.col("class_print").isNull(), F.col("doc_id")).otherwise(F.col("near_class")))
    return far.unionByName(near.drop("class_print", "class_hash"))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """compare_with_edited() of every document, and its near_class."""
    return near_classes(staged(compare_with_edited(documents)))
