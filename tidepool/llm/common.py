"""Shared pieces of the training-data operators: word splitting on Arrow buffers, bounded chunks, hashing, staging.

Every per-row kernel here works on Arrow batches with numpy, in chunks whose text is bounded by ``CHUNK_BYTES``, so
a task's memory doesn't depend on the size of its partition (a single text longer than that is a chunk of its own).
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a kernel holds at a time.
CHUNK_BYTES = 12 << 20
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 6 << 20

#: The ASCII white space of the word pattern [^\x20\x09-\x0D]+.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a temporary one only where it's unset on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidepool-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    """This application's folder of staged tables; the driver's end deletes it."""
    path = f"{shared_dir(spark)}/tidepool/{spark.sparkContext.applicationId}"
    if path not in _STAGED:
        _STAGED.add(path)
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


_STAGED: set[str] = set()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query in here as it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, and a lost executor costs no recomputation.

    What was shuffled for it is deleted with the write, so disk holds the staged tables and one query's shuffles.
    """
    spark = df.sparkSession
    path = f"{_session_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if folder.rsplit("/", 2)[-2] == t.sparkSession.sparkContext.applicationId:
                at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(documents: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, by one narrow aggregation; sizes the number of hash buckets and groups."""
    return documents.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def buckets_for(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX_A
    h ^= h >> np.uint64(27)
    h = h * MIX_B
    h ^= h >> np.uint64(31)
    return h


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    if not len(values):
        return np.zeros(0, dtype=np.uint64)
    return mix(pd.util.hash_array(np.array(values.to_pylist(), dtype=object), categorize=False))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes; small batches are joined."""
    limit = limit or CHUNK_BYTES
    held: list[pa.RecordBatch] = []
    held_bytes = 0

    def together() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit - held_bytes, side="right")))
            if held and stop == start + 1 and ends[start] - before + held_bytes > limit:
                yield together()
                held, held_bytes = [], 0
                continue
            held.append(batch.slice(start, stop - start))
            held_bytes += int(ends[stop - 1] - before)
            start = stop
            if held_bytes >= limit:
                yield together()
                held, held_bytes = [], 0
                give_back()
    if held:
        yield together()
    held = []
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


@dataclass
class Words:
    """The words of a batch of texts: ``values`` distinct words, ``codes`` one index per occurrence, ``offsets`` per text."""

    values: pa.Array
    codes: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_strings(self.values)[self.codes]


def text_array(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    x = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(x.cast(pa.string()) if x.type != pa.string() else x, "")


def words_of(texts: pa.Array, lower: bool) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; ``lower`` folds A-Z only."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if not full.all():
        kept = np.zeros(len(full) + 1, dtype=np.int64)
        np.cumsum(full, out=kept[1:])
        codes, offsets = codes[full], kept[offsets]
    return Words(coded.dictionary, codes, offsets)


def count_words(texts: pa.Array) -> np.ndarray:
    """Words per text, straight from the UTF-8 buffer."""
    if not len(texts):
        return np.zeros(0, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~WHITE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = word[edges]
    return np.diff(np.searchsorted(np.flatnonzero(start), offsets))


def owners(offsets: np.ndarray) -> np.ndarray:
    """The index of the text that each element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``values`` one after another, and their offsets."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    index = np.repeat(starts - ends[:-1], lengths)
    index += np.arange(ends[-1])
    return values[index], ends


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` between the JVM and Python, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not (now.isdigit() and int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Project to the columns an operator reads, renamed, so that clashing or further columns do no harm."""
    small_batches(df.sparkSession)
    names = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{names.get(source.lower(), source)}`").alias(name) for name, source in columns.items()])


#: Hashes of a sieve's segment, which one task builds.
SEGMENT_HASHES = 4 << 20


class Sieve:
    """A Bloom filter of 64-bit hashes, for thinning before a shuffle: it lets every member through, and some others.

    Built in segments by as many tasks, at most ``most`` bytes in all however many hashes there are (beyond that size it
    only thins less), so it may be broadcast.
    """

    def __init__(self, segments: dict[int, bytes], total: int, size: int):
        self.total, self.size = total, size
        self.bits = np.frombuffer(b"".join(segments.get(i, bytes(size)) for i in range(total)), dtype=np.uint8)

    @staticmethod
    def places(h: np.ndarray, total: int, size: int) -> list[np.ndarray]:
        m = mix(h + GOLD)
        start = (m >> np.uint64(48)) % np.uint64(total) * np.uint64(8 * size)
        return [(start + (x % np.uint64(8 * size))).astype(np.int64) for x in (m & np.uint64(0xFFFFFFFF), mix(m) & np.uint64(0xFFFFFFFF), mix(m + GOLD) & np.uint64(0xFFFFFFFF))]

    @classmethod
    def of(cls, hashes: DataFrame, column: str, most: int = 48 << 20) -> Sieve:
        n = hashes.count()
        total = 1 if n < 100_000 else min(1 << 16, max(64, -(-n // SEGMENT_HASHES)))
        size = max(64, min(-(-n * 12 // 8 // total), most // total))
        ddl = "segment int, bits binary"

        def built(key: tuple, rows: pa.Table) -> pa.Table:
            at = cls.places(rows.column("h").to_numpy().view(np.uint64), total, size)
            flags = np.zeros(8 * size, dtype=bool)
            for x in at:
                flags[x - key[0].as_py() * 8 * size] = True
            return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                segment = ((mix(h + GOLD) >> np.uint64(48)) % np.uint64(total)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(segment), b.column(0)], names=["segment", "h"])

        rows = hashes.select(F.col(column).alias("h")).mapInArrow(dealt, "segment int, h long").groupBy("segment").applyInArrow(built, ddl)
        return cls({r["segment"]: bytes(r["bits"]) for r in rows.collect()}, total, size)

    def test(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for p in self.places(h, self.total, self.size):
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        return out


def maybe_among(hashes: DataFrame, column: str) -> Callable[[Column], Column]:
    """A predicate on a long column: true for all values of ``hashes``, and for few others. No row is shuffled for it.

    What it keeps is joined to ``hashes``; what it leaves out needs no join, so most texts stay where they are.
    """
    sieve = hashes.sparkSession.sparkContext.broadcast(Sieve.of(hashes, column))

    def test(x: pd.Series) -> pd.Series:
        return pd.Series(sieve.value.test(x.to_numpy(dtype=np.int64).view(np.uint64)))

    return F.pandas_udf(test, "boolean")
