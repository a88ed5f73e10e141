"""Mixing sources to target weights by pivotal dependent rounding.

Each document gets a fractional number of copies, its source's target over its source's size. Whole copies are certain;
the fractions are rounded by pairing: two fractional documents exchange probability mass, in words, in a random
direction chosen so that every expectation stays, until one of them is integral. What a pair transfers leaves the
expected number of words unchanged, so a source's words move only by the last unpaired document. The largest
documents of a group are settled first, each by pairs with as many smaller ones as it takes. Groups of a source
(salted, so that a hot source is many groups) each hand on their unpaired document and their smallest few as change; a
reduction tree of such groups combines them.

Nulls: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; a null doc_id
is an ordinary value. Repeated rows are rounded one by one. Empty tables give no rows. Only the three columns named are
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import chunks, count_words, only, staged, text_array

#: Rows of one group of the reduction tree's leaves, and groups that meet in one inner group.
GROUP_ROWS, FAN_IN = 10_000, 64
#: The smallest documents of a group that stay unpaired for the next level, so that the root has small change.
CHANGE = 16
#: The largest documents of a group, each settled by exchanges with as many smaller ones as it takes.
MOST_LARGE = 256
#: Sources up to which the table of targets is broadcast; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 10_000

_SIZED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("row", pa.int64()), ("size", pa.int64())])
_ROWS = "doc_id long, row long, source string, size long, source_size long, target double, salt long, whole long, p double, done boolean"


def document_sizes(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, row (a hash of id and text), size: words ``[^\\x20\\x09-\\x0D]+`` of each text."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), b.column(3), pa.array(count_words(text_array(b)))], schema=_SIZED)

    rows = only(documents, doc_id=doc_id, source=source, text=text)
    return rows.withColumn("row", F.xxhash64("text", "doc_id")).mapInArrow(sized, "doc_id long, source string, row long, size long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """source, source_size, target, docs: ``share`` of all words dealt out by repeating weights, at most ``ceiling`` times a source's size.

    Resharing the excess by weight until no target is above its ceiling ends at target = min(ceiling * size, x * weight)
    for one x; the sources with the smallest ceiling per unit of weight are capped first, so x follows from running sums.
    One row per source reaches the windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(ceiling) * F.col("source_size"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "total": F.sum("source_size").over(every) * F.lit(share),
        "nth": F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())),
        "capped": F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)),
    })
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # the first source that its own level leaves uncapped fixes x for all
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    per = per.withColumn("x", F.min(fits).over(every)["level"])
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("x") * F.col("weight"), F.col("cap"))).alias("target"), "docs")


def _round(rows: pd.DataFrame, root: bool, seed: int, level: int) -> pd.DataFrame:
    """Pair a group's fractional documents, largest first; all but the residual and the change end integral."""
    rows = rows.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    p, w, done = rows["p"].to_numpy(copy=True), rows["size"].to_numpy(dtype=np.float64), rows["done"].to_numpy(copy=True)
    todo = np.flatnonzero(~done)
    if len(todo):
        first = rows.iloc[0]
        name = str(first["source"]).encode() if first["source"] is not None else b"\0null"
        keys = np.random.SeedSequence([seed, level, int(first["salt"]), *name])
        luck = np.random.Generator(np.random.Philox(keys)).random(2 * len(todo) + 1)
        paired = todo if root else todo[: max(0, len(todo) - CHANGE)]
        paired = paired[_largest(p, w, done, paired, todo, luck[len(todo) :]) :]
        paired = paired[~done[paired]]
        held, k = -1, 0
        for j in paired.tolist():
            if held < 0:
                held = j
                continue
            i, ratio = held, w[j] / w[held]
            up, down = min(1.0 - p[i], p[j] * ratio), min(p[i], (1.0 - p[j]) * ratio)
            a, b = p[i], p[j]
            if luck[k] * (up + down) < down:
                p[i], p[j] = a + up, b - up / ratio
            else:
                p[i], p[j] = a - down, b + down / ratio
            k += 1
            left = -1
            for x in (i, j):
                if p[x] < 1e-9 or p[x] > 1 - 1e-9:
                    p[x], done[x] = round(p[x]), True
                else:
                    left = x
            held = left
        if root and held >= 0:
            p[held], done[held] = float(luck[-1] < p[held]), True
    rows["p"], rows["done"] = p, done
    return rows


def _largest(p: np.ndarray, w: np.ndarray, done: np.ndarray, paired: np.ndarray, todo: np.ndarray, luck: np.ndarray) -> int:
    """Settle the largest documents one after another; how many were settled.

    One small partner can't take up a large document's mass, so a large one would be left over. Its coin is thrown once, and
    it then exchanges mass with single partners, the largest first, each as far as the partner's probability may go
    either way, until it's integral itself: (1 - p) c to it if it rises, p c from it if it falls, so expectations stay.
    """
    for n, i in enumerate(paired[:MOST_LARGE].tolist()):
        if done[i]:
            continue
        rest = todo[n + 1 :]
        room = np.minimum(p[rest] / (1.0 - p[i]), (1.0 - p[rest]) / p[i])
        moved = np.cumsum(room * w[rest])
        if not len(rest) or moved[-1] < w[i]:
            return n
        last = int(np.searchsorted(moved, w[i]))
        partners, room = rest[: last + 1], room[: last + 1]
        room[last] = max(0.0, room[last] - (moved[last] - w[i]) / w[rest[last]])
        up = luck[n] < p[i]
        p[partners] -= room * ((1.0 - p[i]) if up else -p[i])
        p[i], done[i] = float(up), True
        whole = partners[(p[partners] < 1e-9) | (p[partners] > 1 - 1e-9)]
        p[whole], done[whole] = np.round(p[whole]), True
    return min(MOST_LARGE, len(paired))


def _rounder(root: bool, seed: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _round(rows, root, seed, level)[_NAMES]


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 20_11, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, row, source, size, source_size, target, copies, taken: whole copies of each document, words near each source's target.

    ``ceiling`` must be a whole number, so that no document exceeds it. The same rows give the same mix again.
    """
    sizes = staged(document_sizes(documents))
    targets = staged(source_targets(sizes, weights, share, ceiling))
    widest = targets.agg(F.count("*"), F.coalesce(F.max("docs"), F.lit(0))).first()
    small = F.broadcast(targets) if widest[0] <= BROADCAST_SOURCES else targets
    t = small.withColumnRenamed("source", "t_source")
    salts = F.ceil(F.col("docs") / F.lit(group_rows)).cast("long")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id", "row", "source", "size", "source_size", "target",
        F.pmod(F.xxhash64("doc_id", "size"), salts).alias("salt"),
        F.floor(f + F.lit(1e-12)).cast("long").alias("whole"),
        F.greatest(f - F.floor(f + F.lit(1e-12)), F.lit(0.0)).alias("p"),
    )
    rows = rows.withColumn("done", (F.col("p") <= 0) | (F.col("size") == 0)).withColumn("p", F.when(F.col("done"), F.lit(0.0)).otherwise(F.col("p")))
    groups, level, out = max(1, -(-widest[1] // group_rows)), 0, None
    while True:
        root = groups <= 1
        rows = staged(rows.groupBy("source", "salt").applyInPandas(_rounder(root, seed, level), _ROWS))
        over = rows.filter("done")
        out = over if out is None else out.unionByName(over)
        if root:
            break
        rows = rows.filter("not done").withColumn("salt", F.floor(F.col("salt") / F.lit(FAN_IN)))
        groups, level = -(-groups // FAN_IN), level + 1
    return out.select("doc_id", "row", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"), ((F.col("whole") + F.col("p").cast("long")) * F.col("size")).alias("taken"))


_NAMES = [x.split()[0] for x in _ROWS.split(", ")]



def repeat_by_copies(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each row as often as it has copies. ``mixed`` is mix_sources(documents).

    Rows that repeat id and text, where there are any, are told apart by a running number within them.
    """
    names = {c.lower(): c for c in documents.columns}
    doc_id, text = (F.col(f"`{names[c]}`") for c in ("doc_id", "text"))
    left = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"), doc_id.cast("long").alias("id"), F.xxhash64(text, doc_id).alias("row"))
    right = mixed.select(F.col("doc_id").alias("m_id"), F.col("row").alias("m_row"), "copies")
    same = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("row") == F.col("m_row"))
    if right.groupBy("m_id", "m_row").count().filter("count > 1").take(1):
        left = left.withColumn("nth", F.row_number().over(Window.partitionBy("id", "row").orderBy("id")))
        right = right.withColumn("m_nth", F.row_number().over(Window.partitionBy("m_id", "m_row").orderBy("copies")))
        same = same & (F.col("nth") == F.col("m_nth"))
    # the mix has a row for each document, so it's not to be broadcast however small it looks
    joined = left.join(right.filter("copies > 0").hint("merge"), same)
    return joined.select("whole", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("whole.*")
