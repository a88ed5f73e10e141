"""Retrieval quality: recall at 3, reciprocal rank and forbidden hits, over all cases at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(results: DataFrame, expected: DataFrame, forbidden: DataFrame | None = None, empty: DataFrame | None = None, at: int = 3) -> DataFrame:
    """case, recall_at_3, reciprocal_rank, forbidden_hits, passed. All inputs have case; results path and rank, the others path.

    Cases that expect nothing (``empty``) have a null recall and pass if they have no results.
    """
    marked = expected.select("case", "path", F.lit(1).alias("wanted")).join(results, ["case", "path"], "left")
    per = marked.groupBy("case").agg((F.count_if(F.col("rank") <= at) / F.count("*")).alias("recall_at_3"), F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))
    if empty is not None:
        per = per.unionByName(empty.join(per, "case", "left_anti").select("case", F.lit(None).cast("double").alias("recall_at_3"), F.lit(0.0).alias("reciprocal_rank")))
    leaked = per.select("case").limit(0).withColumn("leaked", F.array().cast("array<string>"))
    if forbidden is not None:
        leaked = results.join(forbidden.select("case", "path"), ["case", "path"], "left_semi").groupBy("case").agg(F.array_sort(F.collect_set(F.col("path").cast("string"))).alias("leaked"))
    found = results.groupBy("case").agg(F.count("*").alias("n"))
    out = per.join(leaked, "case", "left").join(found, "case", "left")
    hits = F.coalesce("leaked", F.array().cast("array<string>"))
    ok = F.when(F.col("recall_at_3").isNull(), F.coalesce("n", F.lit(0)) == 0).otherwise(F.col("recall_at_3") > 0)
    return out.select("case", "recall_at_3", "reciprocal_rank", hits.alias("forbidden_hits"), (ok & (F.size(hits) == 0)).alias("passed"))


def summary(per_case: DataFrame) -> DataFrame:
    """One row: passed, total, and the means over cases that expect something."""
    scored = F.col("recall_at_3").isNotNull()
    return per_case.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.avg("recall_at_3").alias("recall_at_3"), F.avg(F.when(scored, F.col("reciprocal_rank"))).alias("mrr_at_5"))
