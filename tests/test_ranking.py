"""Ranks over skewed scores, and many queries in one plan against each by itself."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import ranking


@pytest.mark.parametrize("scores", [lambda r: 1.0, lambda r: r.choice([0.5, 0.5, 0.5, 2.0]), lambda r: r.uniform(-1, 1), lambda r: 1 + r.random() * 1e-9])
def test_ranks_are_row_numbers(spark, scores):
    r = random.Random(3)
    rows = [(f"p{i:05}", scores(r)) for i in r.sample(range(99999), 3000)]
    got = {x["path"]: x["rank"] for x in ranking.ranked(spark.createDataFrame(rows, "path string, score double").repartition(5)).collect()}
    assert got == {p: n for n, (p, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}


def test_equal_scores_are_many_tasks(spark):
    """A million rows of one score: no task has more than an eighth of them."""
    best = spark.range(1_000_000).select(F.col("id").alias("path"), F.lit(1.0).alias("score"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be put together again
    try:
        out = ranking.ranked(best)
        row = out.agg(F.count("*"), F.min(F.col("rank") - F.col("path")), F.max(F.col("rank") - F.col("path"))).first()
        tasks = out.groupBy(F.spark_partition_id().alias("t")).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(row) == (1_000_000, 1, 1) and tasks <= 125_000


def test_no_rows_and_one(spark):
    empty = spark.createDataFrame([], "path string, score double")
    assert ranking.ranked(empty).count() == 0
    assert ranking.ranked(spark.createDataFrame([("a", 1.0)], empty.schema)).first()["rank"] == 1


def test_many_cases_are_each_of_them(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, r.choice(["en", "de", None]), r.choices(words, range(1, 13), k=r.choice([0, 2, 40])) if i % 17 else None) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>").repartition(3).cache()
    parts = [None, F.col("lang") == "en", F.col("lang").isNull(), F.col("doc_id") < 0, F.col("doc_id") % 2 == 0]
    cases = {f"c{i}": (r.sample(words, 3) + (["nowhere"] if i % 4 == 0 else []), parts[i % 5]) for i in range(12)} | {"none": ([], None), "unknown": (["zzz"], None)}
    got = {}
    for x in ranking.bm25_many(d, cases).collect():
        got.setdefault(x["case"], {})[x["doc_id"]] = x["score"]
    for case, (terms, part) in cases.items():
        pool = d if part is None else d.filter(part)
        one = ranking.bm25(pool.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))).select("doc_id", "tokens"), sorted(terms))
        assert {x["doc_id"]: pytest.approx(x["score"]) for x in one.collect()} == got.get(case, {}), case


def test_many_cases_read_the_texts_once_and_shuffle_no_tokens(spark, data):
    from tidepool import queries

    plan = queries.QUERIES["evaluation_batch"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastHashJoin" in plan
