"""Exact cosine search with pruning: every vector's angles to a few pivots stand beside it, and the triangle inequality of
angles leaves out what can't be within the query's angle. Angles are plain columns, so the bounds are pushed to the scan, and
files are sorted by the nearest pivot, so that whole row groups and folders fall out.

How much is left out depends on the vectors: much where they lie in clusters and the least score is high, nothing where all are
at right angles. No row is missed in either case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.ranking import cosine, dot, norm

#: Pivots, and the vectors (by hash) that they are chosen from; an angle may be off by so much in its last digits.
PIVOTS, SAMPLED, SLACK = 8, 500, 1e-6


def chosen(vectors: DataFrame, count: int = PIVOTS, vector: str = "vector") -> list[list[float]]:
    """Unit vectors far from each other, out of a sample of at most SAMPLED: each next one is the farthest from those before."""
    rows = vectors.select(F.col(vector).alias("v"), F.xxhash64(vector).alias("h")).orderBy("h").limit(SAMPLED).collect()
    units = [[x / math.sqrt(math.fsum(y * y for y in r["v"])) for x in r["v"]] for r in rows]
    out = units[:1]
    nearest = [2.0] * len(units)
    while units and len(out) < count:
        nearest = [min(d, 1 - math.fsum(a * b for a, b in zip(u, out[-1], strict=True))) for u, d in zip(units, nearest, strict=True)]
        far = max(range(len(units)), key=lambda i: nearest[i])
        if nearest[far] < SLACK:
            break
        out.append(units[far])
    return out


def _angle(v: Column, unit: list[float]) -> Column:
    c = dot(v, F.array(*[F.lit(float(x)) for x in unit])) / norm(v)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def write(vectors: DataFrame, path: str, count: int = PIVOTS, vector: str = "vector") -> list[list[float]]:
    """Write valid vectors with their angles a0, a1, ... by the cell of the nearest pivot; the pivots stand in a table beside."""
    points = chosen(vectors, count, vector)
    rows = vectors.withColumns({f"a{i}": _angle(F.col(vector), p) for i, p in enumerate(points)})
    angles = F.array(*[F.col(f"a{i}") for i in range(len(points))]) if points else F.array(F.lit(0.0))
    rows = rows.withColumn("cell", (F.array_position(angles, F.array_min(angles)) - 1).cast("int")).hint("rebalance", "cell")
    writer = rows.sortWithinPartitions("cell", *(["a0"] if points else [])).write.mode("overwrite")
    (writer.partitionBy("cell") if points else writer).parquet(f"{path}/vectors")  # without vectors one empty file, for its columns
    spark = vectors.sparkSession
    spark.createDataFrame(list(enumerate(points)), "i int, pivot array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    return points


def near(spark: SparkSession, path: str, query: list[float], least: float, vector: str = "vector") -> DataFrame:
    """Rows of a written table whose cosine with the query reaches ``least``, with score: those of a scan of all."""
    points = [r["pivot"] for r in spark.read.parquet(f"{path}/pivots").orderBy("i").collect()]
    rows = candidates(spark, path, points, query, least)
    return cosine(rows, query, least, vector).drop("cell", *[f"a{i}" for i in range(len(points))])


def candidates(spark: SparkSession, path: str, points: list[list[float]], query: list[float], least: float) -> DataFrame:
    """Rows that no pivot rules out: their angle to it differs from the query's by no more than the widest angle asked for."""
    rows = spark.read.parquet(f"{path}/vectors")
    size = math.sqrt(math.fsum(x * x for x in query))
    widest = math.acos(max(-1.0, min(1.0, least))) + SLACK
    for i, p in enumerate(points):
        at = math.acos(max(-1.0, min(1.0, math.fsum(a * b for a, b in zip(p, query, strict=True)) / size)))
        rows = rows.filter(F.col(f"a{i}").between(at - widest, at + widest))
    return rows
