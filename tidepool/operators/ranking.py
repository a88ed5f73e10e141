"""Scoring and ranking: BM25 over a pool, cosine over vectors, best chunk per note, reciprocal rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, RRF = 1.2, 0.75, 60


def counted_with(columns: list[str]) -> Column:
    """count(*) that reads all the columns named: two branches of a plan that use it ask for the same ones, so their exchange is made once."""
    return F.when(F.max(F.struct(*columns)).isNotNull(), F.count(F.lit(1))).otherwise(F.lit(0))


def term_counts(tokens: str, terms: list[str]) -> Column:
    """array<int>: how often each term occurs. One pass picks the terms out of the tokens; the rest works on those few."""
    return F.aggregate(
        F.filter(tokens, lambda t: t.isin(terms)),
        F.array_repeat(F.lit(0), len(terms)),
        lambda counts, t: F.zip_with(counts, F.array(*[(t == w).cast("int") for w in terms]), lambda a, b: a + b),
    )


def bm25(pool: DataFrame, terms: list[str], tokens: str = "tokens") -> DataFrame:
    """The pool's rows that hold a term, without their tokens, and their BM25 score; N, df and average length are the pool's own.

    Only the query's few terms are counted, in place, so tokens are never exploded. Rows of a few numbers are dealt out
    once; the statistics, one row, and the scores both read that exchange, so the texts are read and cut once (if all
    columns of the pool are used; give it no others).
    """
    kept = [c for c in pool.columns if c != tokens]
    if not terms:
        return pool.select(*kept, F.lit(0.0).alias("score")).limit(0)
    slim = [*kept, "__tf", "__len"]
    rows = pool.withColumn("__tf", term_counts(tokens, terms)).withColumn("__len", F.size(tokens)).select(*slim)
    rows = rows.hint("rebalance")  # in partitions as large as adaptive execution wants them
    stats = rows.agg(
        counted_with(slim).alias("__n"),
        F.coalesce(F.nullif(F.avg("__len"), F.lit(0.0)), F.lit(1.0)).alias("__avg"),
        F.array(*[F.sum((F.col("__tf")[i] > 0).cast("long")) for i in range(len(terms))]).alias("__df"),
    )
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col("__tf")[i], F.col("__df")[i]
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        part = idf * tf * (K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("__len") / F.col("__avg")))
        score = score + F.when(tf > 0, part).otherwise(0.0)
    scored = rows.crossJoin(F.broadcast(stats)).withColumn("score", score)  # one row
    return scored.filter("score > 0").select(*kept, "score")


def bm25_many(rows: DataFrame, cases: dict[object, tuple[list[str], Column | None]], doc: str = "doc_id", tokens: str = "tokens", names: str = "string") -> DataFrame:
    """case, ``doc``, score: many queries in one plan. A case has terms and a predicate that its pool is cut by (None: all rows).

    The tokens are looked through once, for the terms of all cases; a row says which pools it is in. Every pool has its own N,
    average length and document frequencies. What the cases ask for, a row for each case and term, is broadcast.
    """
    spark = rows.sparkSession
    pools: dict[str, tuple[int, Column]] = {}
    asked: list[tuple] = []
    for case, (terms, part) in cases.items():
        part = F.lit(True) if part is None else part
        pool, _ = pools.setdefault(str(part), (len(pools), part))
        asked += [(case, pool, t) for t in sorted(set(terms))]
    wanted = sorted({t for _, _, t in asked})
    at = [F.when(part, F.lit(i)) for i, part in pools.values()]
    inside = F.filter(F.array(*at), lambda i: i.isNotNull()) if at else F.array().cast("array<int>")
    held = rows.select(doc, inside.alias("pools"), F.greatest(F.size(tokens), F.lit(0)).alias("len"), F.filter(tokens, lambda t: t.isin(wanted)).alias("hits"))
    tf = F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("term"), F.size(F.filter("hits", lambda x: x == t)).alias("tf")))
    found = held.select(doc, "pools", "len", F.explode(tf).alias("t")).select(doc, "pools", "len", "t.*")

    sizes = held.select(F.explode("pools").alias("pool"), "len").groupBy("pool").agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("average"))
    df = found.select(F.explode("pools").alias("pool"), "term").groupBy("pool", "term").agg(F.count("*").alias("df"))
    weights = spark.createDataFrame(asked, f"case {names}, pool int, term string").join(df, ["pool", "term"]).join(sizes, "pool")
    weights = weights.select("case", "pool", "term", "average", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    each = found.join(F.broadcast(weights), (found["term"] == weights["term"]) & F.array_contains("pools", F.col("pool")))  # a row for each case and term
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.col("average")))
    return each.groupBy("case", doc).agg(F.sum(part).alias("score")).filter("score > 0")


def document_frequency(pool: DataFrame, terms: list[str], tokens: str = "tokens") -> DataFrame:
    """term, df: in how many rows each term occurs."""
    hits = pool.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, terms)))).alias("term"))
    return hits.groupBy("term").agg(F.count("*").alias("df"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def valid_vector(v: Column, dimensions: int | None = None) -> Column:
    """Not empty, of the right size, finite throughout, and with a finite norm above zero."""
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if dimensions is not None:
        ok = ok & (F.size(v) == dimensions)
    return F.coalesce(ok & (norm(v) > 0) & (norm(v) < float("inf")), F.lit(False))


def normalised(v: Column) -> Column:
    """v over its norm, which is worked out once."""
    return F.zip_with(v, F.array_repeat(norm(v), F.size(v)), lambda x, n: x / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(rows: DataFrame, query: list[float], least: float, vector: str = "vector") -> DataFrame:
    """Rows whose normalised vector reaches ``least`` against one query vector, a literal in the plan."""
    size = math.sqrt(math.fsum(x * x for x in query))
    q = F.array(*[F.lit(float(x) / size) for x in query])
    scored = rows.withColumn("score", dot(F.col(vector), q) / norm(F.col(vector)))
    return scored.filter(F.col("score") >= least)


def best_chunk(scored: DataFrame, path: str = "path", order: str = "chunk_ord") -> DataFrame:
    """The best row of each note; the first wins ties. Reduced by aggregation, so a long note is never one task's sort."""
    best = F.max_by(F.struct(*[F.col(c) for c in scored.columns]), F.struct(F.col("score"), -F.col(order)))
    return scored.groupBy(F.col(path).alias("__path")).agg(best.alias("b")).select("b.*")


#: Ranges that ranks are worked out in, and rows of the sample that their ends are taken from.
RANGES, SAMPLED = 64, 2048


def ranked(best: DataFrame, path: str = "path") -> DataFrame:
    """rank from 1 by score, then path.

    A sample by hash, one row of at most SAMPLED places, cuts the order of (score, path) in ranges of like sizes; each is
    sorted by itself, and only the ranges' counts meet in one task. Equal scores are cut by path, so no score is one task's.
    """
    columns, place = best.columns, F.struct((-F.col("score")).alias("s"), F.col(path).alias("p"))
    sample = best.select(place.alias("x"), F.xxhash64(path).alias("h")).orderBy("h", "x").limit(SAMPLED)
    sorted_ = sample.agg(F.sort_array(F.collect_list("x")).alias("x"))
    every = F.greatest(F.ceil(F.size("x") / F.lit(RANGES)), F.lit(1)).cast("int")
    ends = sorted_.select(F.filter("x", lambda _, i: i % every == every - 1).alias("__ends"))
    cut = best.crossJoin(F.broadcast(ends)).withColumn("__range", F.size(F.filter("__ends", lambda e: e < place))).drop("__ends")  # one row
    rows = cut.repartition("__range")
    above = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__range").agg(counted_with([*columns, "__range"]).alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))  # a number per range
    own = Window.partitionBy("__range").orderBy(F.col("score").desc(), F.col(path))
    nth = rows.withColumn("__nth", F.row_number().over(own))
    return nth.join(F.broadcast(before), "__range").select(*columns, (F.col("__before") + F.col("__nth")).cast("int").alias("rank"))


def fuse(branches: dict[str, DataFrame], path: str = "path") -> DataFrame:
    """path, score, matched_by: reciprocal rank fusion of ranked branches (path, key, score, rank)."""
    parts = [b.select(F.col(path).alias("path"), F.lit(i).alias("nth"), F.lit(name).alias("branch"), "key", "rank") for i, (name, b) in enumerate(branches.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("path").agg(
        F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))).alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "branch"))), lambda x: x["branch"]).alias("matched_by"),
        F.collect_set("key").alias("best_keys"),
    )
