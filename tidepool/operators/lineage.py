"""Replacement chains: notes that name the note which supersedes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def follow(links: DataFrame) -> DataFrame:
    """node, target, chain, problem. ``links``: node, superseded, next (null where it can't be resolved).

    Pointers are doubled: each round, a chain continues with the chain of where it stands, so a chain of length n takes
    log n joins. What no round shortens any more runs in a cycle.
    """
    state = links.select("node", F.when(F.col("superseded"), F.col("next")).otherwise(F.col("node")).alias("at"), F.when(F.col("superseded"), F.array("node")).otherwise(F.array().cast("array<" + dict(links.dtypes)["node"] + ">")).alias("chain"), (~F.col("superseded")).alias("ended"))
    state = _kept(state)
    left = None
    while True:
        open_ = state.filter("not ended and at is not null").count()
        if open_ == 0 or open_ == left:
            break
        left = open_
        on = state.select(F.col("node").alias("j"), F.col("at").alias("j_at"), F.col("chain").alias("j_chain"), F.col("ended").alias("j_ended"))
        moved = state.join(on, (F.col("at") == F.col("j")) & ~F.col("ended"), "left")
        far = F.col("j").isNotNull()
        state = moved.select("node", F.when(far, F.col("j_at")).otherwise(F.when(F.col("ended"), F.col("at"))).alias("at"), F.when(far, F.concat("chain", "j_chain")).otherwise(F.col("chain")).alias("chain"), (F.col("ended") | F.coalesce("j_ended", F.lit(False))).alias("ended"))
        state = _kept(state)
    problem = F.when(F.col("ended"), F.lit(None).cast("string")).when(F.col("at").isNull(), F.lit("replacement_missing")).otherwise(F.lit("replacement_cycle"))
    return state.select("node", F.when(F.col("ended"), F.col("at")).alias("target"), "chain", problem.alias("problem"))


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, from the context or the session; without one (tests) keep it in memory."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not where:
            return df.cache()
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def _names(notes: DataFrame, column: str) -> DataFrame:
    """name, n, path: how many notes have a name, and one of them. One row a name, however many notes share it."""
    named = notes.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name"))
    return named.agg(F.count("*").alias("n"), F.min("path").alias("path"))


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """node, next: what each link (node, folder, target) names among notes (path, stem, title).

    An exact path, beside the linking note or from the root, with or without ``.md``, if just one note has one; else the
    one note whose stem or title is the target. Names are reduced to one row each before links meet them, so a common
    title costs no more than a rare one; what a link finds is counted in one aggregation.
    """
    md = lambda c: F.when(c.endswith(".md"), F.array(c)).otherwise(F.array(c, F.concat(c, F.lit(".md"))))
    beside = F.when(F.col("folder") != "", F.concat("folder", F.lit("/"), "target")).otherwise(F.col("target"))
    found = lambda kind: ["node", F.lit(kind).alias("kind"), "n", "path"]
    options = links.select("node", F.explode(F.array_distinct(F.concat(md(beside), md(F.col("target"))))).alias("path"))
    exact = options.join(notes.select("path"), "path").withColumn("n", F.lit(1).cast("long")).select(*found("exact"))
    stems = links.select("node", F.regexp_replace("target", r"\.md$", "").alias("name")).join(_names(notes, "stem"), "name").select(*found("stem"))
    titles = links.select("node", F.col("target").alias("name")).join(_names(notes, "title"), "name").select(*found("title"))
    none = links.select("node", F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("path"))
    sole = lambda kinds: F.when((F.sum(F.when(kinds, F.col("n"))) == F.count_if(kinds)) & (F.min(F.when(kinds, F.col("path"))) == F.max(F.when(kinds, F.col("path")))), F.min(F.when(kinds, F.col("path"))))
    every = none.unionByName(exact).unionByName(stems).unionByName(titles).groupBy("node")
    return every.agg(F.coalesce(sole(F.coalesce(F.col("kind") == "exact", F.lit(False))), sole(F.coalesce(F.col("kind").isin("stem", "title"), F.lit(False)))).alias("next"))


def best_source(scored: DataFrame, target: str = "target", source: str = "source") -> DataFrame:
    """Per target: the source of the highest score (ties: the smaller), and all chains in that order."""
    order: Column = F.struct(-F.col("score"), F.col(source))
    return scored.groupBy(target).agg(F.min_by(source, order).alias(source), F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "chain"))), lambda x: x["chain"]).alias("chains"))
