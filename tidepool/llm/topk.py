"""Exact top-k inner-product search by a vector-approximation file.

``VectorFile.build`` writes two tables to the shared folder: the vectors as they are, and beside them the approximation,
one byte a component: which of ``2**bits`` equal cells between the column's exact minimum and maximum holds it. A
search scans the approximation only. For uniform cells the product of a query with a vector lies within ``|q| . half a
cell`` of its product with the cells' middles, so each product bounds a score from both sides. The first scan takes,
per query, the k-th best lower bound of any partition as a threshold; the second finds the vectors whose upper bound
reaches some query's. Exact vectors are read of these only: files without any are not opened, other vectors are held
back by a sieve of row numbers, and what is left is scored in the order of the bounds until the k-th result is certain.

Scores are exact integers for all finite components: floor(scale * x) is a double without error, sums that doubles may
not hold are added up in Python's integers. ``score`` is the nearest 64-bit integer, ``exact_score`` has all digits, and
ranks follow the latter. Every row is a candidate, also where rows repeat an id or a vector; only the query's own row is not.

Nulls and non-finite components: such vectors take no part, neither do rows without an id. Vectors of another length
than the query's never meet it; an empty vector's scores are 0. Ties go to the smaller id. An empty table gives no rows;
only the two columns named are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import maybe_among, only, staged

#: Bytes of queries that a pass broadcasts; more queries take more passes over the approximation.
QUERY_BYTES = 32 << 20
#: Products held at a time, and rows.
PRODUCTS, BLOCK_ROWS = 4 << 20, 4096
#: Scores taken exactly at a time; sums below this are exact in doubles.
STEP, SAFE = 64, float(1 << 52)

_CODES = pa.schema([("row", pa.int64()), ("codes", pa.binary())])
_BOUND = pa.schema([("q", pa.int64()), ("bound", pa.float64())])
_LIMIT = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())])
_SCORED = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("exact_score", pa.string()), ("key", pa.string())])
_SCORED_DDL = "q long, query_id long, vec_id long, score long, exact_score string, key string"


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """row, vec_id, e: the vectors that take part, with a number each. JVM expressions only."""
    rows = only(vectors, vec_id=vec_id, e=embedding)
    fine = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "e")


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles; infinite beyond their range."""
    with np.errstate(over="ignore"):
        return np.floor(x.astype(np.float64) * scale)


def integers(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of any finite doubles; from 2**53 on they are integers themselves."""
    return [math.floor(c * scale) if abs(c) < 2.0**53 else int(c) * scale for c in x.astype(np.float64).tolist()]


def sort_key(score: int) -> str:
    """A string whose order is the order of the integers: sign, number of digits, digits; those of negative ones turned."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + "".join(str(9 - int(c)) for c in digits)


def _matrices(batches: Iterator[pa.RecordBatch], most: int = BLOCK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, matrix) of at most ``most`` vectors of one length, from row, vec_id, e."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            b = batch.slice(start, most)
            rows, ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            flat, lengths = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            ends = np.cumsum(lengths)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                yield rows[at], ids[at], flat.reshape(len(rows), -1) if len(at) == len(rows) else flat[(ends[at] - d)[:, None] + np.arange(d)]


class Grid:
    """The cells of each dimension, for each vector length."""

    def __init__(self, limits: dict[int, tuple[np.ndarray, np.ndarray]], bits: int):
        self.top = (1 << bits) - 1
        with np.errstate(all="ignore"):
            self.cells = {d: (lo, np.maximum(hi - lo, 1.0) / (1 << bits), np.maximum(np.abs(lo), np.abs(hi))) for d, (lo, hi) in limits.items()}

    def codes(self, x: np.ndarray) -> np.ndarray:
        lo, width, _ = self.cells[x.shape[1]]
        with np.errstate(all="ignore"):
            return np.nan_to_num(np.floor((x - lo) / width), nan=0.0, posinf=self.top, neginf=0.0).clip(0, self.top).astype(np.uint8)

    def middle(self, codes: np.ndarray) -> np.ndarray:
        lo, width, _ = self.cells[codes.shape[1]]
        with np.errstate(all="ignore"):
            return lo + (codes + 0.5) * width


class Queries:
    """Queries by vector length: numbers, own rows and ids, vectors, and how far a bound lies from the middles' product."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], grid: Grid, scale: int):
        self.grid, self.of = grid, {}
        for d in {len(e) for _, _, e in rows} & set(grid.cells):
            own = [r for r in rows if len(r[2]) == d]
            _, width, edge = grid.cells[d]
            raw = np.array([e for *_, e in own], dtype=np.float64).reshape(len(own), d)
            q = scaled(raw, scale)
            with np.errstate(all="ignore"):
                # half a cell of each component, and what doubles may lose on the way
                slack = np.abs(q) @ (width / 2) * (1 + 1e-9) + np.abs(q) @ edge * ((d + 8) * 4e-16) + 1e-6
            self.of[d] = (np.array([r for r, *_ in own], dtype=np.int64), np.array([i for _, i, _ in own], dtype=np.int64), raw, q, np.where(np.isfinite(slack), slack, np.inf))

    def bounds(self, codes: np.ndarray, upper: bool) -> np.ndarray:
        """A bound of every score (vectors, queries); infinite where doubles can't tell."""
        *_, q, slack = self.of[codes.shape[1]]
        with np.errstate(all="ignore"):
            out = self.grid.middle(codes) @ q.T + (slack if upper else -slack)
        return np.where(np.isfinite(out), out, np.inf if upper else -np.inf)

    def most(self) -> int:
        """Vectors whose products with all queries are held at a time."""
        return max(1, min(BLOCK_ROWS, PRODUCTS // max([1, *(len(x[0]) for x in self.of.values())])))


def _coded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, codes) of at most ``most`` vectors of one length, from row, codes."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            b = batch.slice(start, most)
            rows, codes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            lengths = np.array([len(x) for x in codes])
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                yield rows[at], np.frombuffer(b"".join(codes[i] for i in at.tolist()), dtype=np.uint8).reshape(len(at), d)


def _exact(x: np.ndarray, q: np.ndarray, raw: np.ndarray, raw_q: np.ndarray, scale: int) -> list[int]:
    """The scores of the vectors ``x`` (``raw`` before scaling) with a query."""
    with np.errstate(all="ignore"):
        if float((np.abs(x) @ np.abs(q)).max(initial=0)) < SAFE:
            return [int(s) for s in (x @ q).tolist()]
    own = integers(raw_q, scale)
    return [sum(a * b for a, b in zip(integers(v, scale), own, strict=True)) for v in raw]


@dataclass
class VectorFile:
    """The two tables: exact (row, vec_id, e) and approximation (row, codes); and the grid between them."""

    exact: DataFrame
    approximation: DataFrame
    grid: Grid
    scale: int

    @classmethod
    def build(cls, vectors: DataFrame, scale: int = 1024, bits: int = 8) -> VectorFile:
        """From valid_vectors()."""
        exact = staged(vectors)

        def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for _, _, raw in _matrices(batches):
                x = scaled(raw, scale)
                lo, hi = seen.get(x.shape[1], (x[0], x[0]))
                seen[x.shape[1]] = (np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0)))
            for d, (lo, hi) in seen.items():
                # a row of nulls stands for a length without components
                rows = {"d": [d] * max(d, 1), "i": list(range(max(d, 1))), "lo": lo if d else [None], "hi": hi if d else [None]}
                yield pa.RecordBatch.from_pydict(rows, schema=_LIMIT)

        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ranges = exact.mapInArrow(limits, "d int, i int, lo double, hi double").groupBy("d", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        for r in ranges.collect():  # one row per dimension
            lo, hi = found.setdefault(r["d"], (np.zeros(r["d"]), np.zeros(r["d"])))
            if r["d"]:
                lo[r["i"]], hi[r["i"]] = r["lo"], r["hi"]
        grid = Grid(found, bits)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, _, raw in _matrices(batches):
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([x.tobytes() for x in grid.codes(scaled(raw, scale))], pa.binary())], schema=_CODES)

        return cls(exact, staged(exact.mapInArrow(code, "row long, codes binary")), grid, scale)

    def rows_of(self, wanted: DataFrame) -> DataFrame:
        """The exact rows whose number is among ``wanted`` (row), and few others. Files without any are not opened."""
        parts = {r["part"] for r in wanted.select(F.shiftright("row", 33).alias("part")).distinct().collect()}  # a number per file
        files = [f for f in self.exact.inputFiles() if (m := re.search(r"part-(\d+)", f.rsplit("/", 1)[-1])) is None or int(m[1]) in parts]
        if not files:
            return self.exact.limit(0)
        some = self.exact.sparkSession.read.schema(self.exact.schema).parquet(*files)
        return some.filter(maybe_among(wanted, "row")(F.col("row")))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, rank, vec_id, score, exact_score: each query's ``k`` best. ``queries``: row (of this file, or null), vec_id, e."""
        spark, out = queries.sparkSession, None
        size = queries.agg(F.coalesce(F.sum(F.size("e") * 8 + 64), F.lit(0))).first()[0]
        passes = max(1, -(-size // QUERY_BYTES))
        for part in range(passes):
            mine = queries.filter(F.pmod(F.xxhash64("row", "vec_id", "e"), F.lit(passes)) == part).collect()  # QUERY_BYTES at most
            own = [(-1 - n if r["row"] is None else r["row"], r["vec_id"], np.array(r["e"], dtype=np.float64)) for n, r in enumerate(mine)]
            ranked = self._pass(spark.sparkContext.broadcast(Queries(own, self.grid, self.scale)), k)
            out = ranked if out is None else out.unionByName(ranked)
        return out

    def _pass(self, known, k: int) -> DataFrame:  # noqa: ANN001
        spark, scale = self.exact.sparkSession, self.scale

        def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, best = known.value, {}
            for rows, codes in _coded(batches, q.most()):
                d = codes.shape[1]
                if d not in q.of:
                    continue
                low = q.bounds(codes, upper=False)
                low[rows[:, None] == q.of[d][0][None, :]] = -np.inf
                joined = low if d not in best else np.vstack([best[d], low])
                n = min(k, len(joined))
                best[d] = -np.partition(-joined, n - 1, axis=0)[:n]
            for d, b in best.items():
                least = b.min(axis=0)
                fine = np.isfinite(least) if len(b) == k else np.zeros(len(least), dtype=bool)
                if fine.any():
                    yield pa.RecordBatch.from_arrays([pa.array(q.of[d][0][fine]), pa.array(least[fine])], schema=_BOUND)

        floors = self.approximation.mapInArrow(lower, "q long, bound double").groupBy("q").agg(F.max("bound").alias("bound"))
        least = spark.sparkContext.broadcast({r["q"]: r["bound"] for r in floors.collect()})  # a number per query

        def floor(rows: np.ndarray) -> np.ndarray:
            return np.array([least.value.get(i, -np.inf) for i in rows.tolist()])

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = known.value
            at = {d: floor(x[0]) for d, x in q.of.items()}
            for rows, codes in _coded(batches, q.most()):
                d = codes.shape[1]
                if d in q.of:
                    hit = (q.bounds(codes, upper=True) >= at[d]).any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[hit])], names=["row"])

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, best = known.value, {}
            at = {d: floor(x[0]) for d, x in q.of.items()}
            for rows, ids, raw in _matrices(batches, q.most()):
                d = raw.shape[1]
                if d not in q.of:
                    continue
                q_rows, _, q_raw, q_scaled, _ = q.of[d]
                x = scaled(raw, scale)
                high = q.bounds(q.grid.codes(x), upper=True)
                reach = (high >= at[d]) & (rows[:, None] != q_rows[None, :])
                for j in np.flatnonzero(reach.any(axis=0)).tolist():
                    some = np.flatnonzero(reach[:, j])
                    some = some[np.lexsort((ids[some], -high[some, j]))]
                    got = best.get((d, j), [])
                    for s in range(0, len(some), STEP):  # in the order of the bounds, until the k-th is certain
                        now = some[s : s + STEP]
                        if len(got) == k and float(high[now[0], j]) < got[-1][0]:
                            break
                        scores = _exact(x[now], q_scaled[j], raw[now], q_raw[j], scale)
                        got = sorted(got + list(zip(scores, ids[now].tolist(), strict=True)), key=lambda t: (-t[0], t[1]))[:k]
                    best[d, j] = got
            for (d, j), got in best.items():
                n, q_rows, q_ids = len(got), q.of[d][0], q.of[d][1]
                held = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s, _ in got]
                yield pa.RecordBatch.from_pydict({"q": [int(q_rows[j])] * n, "query_id": [int(q_ids[j])] * n, "vec_id": [i for _, i in got], "score": held, "exact_score": [str(s) for s, _ in got], "key": [sort_key(s) for s, _ in got]}, schema=_SCORED)

        wanted = staged(self.approximation.mapInArrow(reached, "row long"))
        top = Window.partitionBy("q").orderBy(F.col("key").desc(), "vec_id")
        ranked = self.rows_of(wanted).mapInArrow(exact, _SCORED_DDL).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "exact_score")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score, exact_score; the rows whose id is divisible by ``every`` are queries, against all other rows."""
    file = VectorFile.build(valid_vectors(vectors), scale)
    return file.search(file.exact.filter(F.col("vec_id") % every == 0), k)
