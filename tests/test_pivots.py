"""Pruned cosine against a scan of all vectors: clustered, random, few and equal ones; what the bounds leave out."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import pivots, ranking


def clusters(n, size, spread, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    return [(i, [c + r.gauss(0, spread) for c in centres[i % 6]]) for i in range(n)], centres


@pytest.mark.parametrize("spread", [0.1, 1.0, 30.0])
@pytest.mark.parametrize("least", [-1.0, 0.05, 0.3, 0.95])
def test_rows_of_a_scan(spark, tmp_path, spread, least):
    rows, centres = clusters(400, 12, spread, 2)
    d = spark.createDataFrame(rows, "id long, vector array<double>")
    points = pivots.write(d, str(tmp_path / "v"))
    for query in (centres[0], [1.0] + [0.0] * 11):
        want = {r["id"]: r["score"] for r in ranking.cosine(d, query, least).collect()}
        got = {r["id"]: r["score"] for r in pivots.near(spark, str(tmp_path / "v"), query, least).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
        left = pivots.candidates(spark, str(tmp_path / "v"), points, query, least).count()
        assert len(want) <= left <= 400
        if spread == 0.1 and least == 0.95 and query is centres[0]:
            assert left <= 2 * len(want) and len(want) == 67  # the other five clusters aren't read


def test_few_equal_and_no_vectors(spark, tmp_path):
    for n, rows in enumerate(([], [(1, [1.0, 0.0])], [(i, [2.0, 2.0]) for i in range(9)])):
        d = spark.createDataFrame(rows, "id long, vector array<double>")
        assert len(pivots.write(d, str(tmp_path / str(n)))) <= 1
        assert pivots.near(spark, str(tmp_path / str(n)), [1.0, 1.0], 0.5).count() == len(rows)


def test_bounds_are_pushed_to_the_scan(spark, tmp_path):
    rows, centres = clusters(60, 4, 0.1, 1)
    pivots.write(spark.createDataFrame(rows, "id long, vector array<double>"), str(tmp_path / "v"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = pivots.near(spark, str(tmp_path / "v"), centres[1], 0.9).select("id", F.round("score", 3))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(a0" in plan and "LessThanOrEqual(a3" in plan and "Python" not in plan
