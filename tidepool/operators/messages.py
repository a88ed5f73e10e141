"""Conversations as a relation of messages: numbering, paging, selecting, excerpts, day headers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.batches import bounded


def is_readable() -> Column:
    return F.coalesce(F.col("role").isin("user", "assistant") & (F.col("text") != ""), F.lit(False))


def numbered(turns: DataFrame, session: str = "conv_id", order: str = "turn", before: DataFrame | None = None, span: int = 4096) -> DataFrame:
    """The readable rows with their number in the session; ``before`` (session, messages) tells how many there were earlier.

    A session is cut into spans of ``span`` values of ``order``. Rows are numbered within their span and only the spans' counts
    are summed up, so a session of any length is many small groups. Ties go by role and text.
    """
    rows = turns.filter(is_readable()).withColumn("__span", F.floor(F.col(order) / F.lit(span)))
    counts = rows.groupBy(session, "__span").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(session).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    if before is not None:
        counts = counts.join(before.select(session, "messages"), session, "left").withColumn("__before", F.col("__before") + F.coalesce("messages", F.lit(0)))
    own = Window.partitionBy(session, "__span").orderBy(order, "role", "text")
    nth = rows.withColumn("__nth", F.row_number().over(own))
    placed = nth.join(counts.select(session, "__span", "__before"), [session, "__span"])
    return placed.select(*turns.columns, (F.col("__before") + F.col("__nth")).cast("long").alias("number"))


def readable(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """User and assistant rows with text, numbered from 1 within their session. Numbers are over readable rows only."""
    rows = turns.filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long"))


def page(messages: DataFrame, offset: int, limit: int, session: str = "conv_id") -> DataFrame:
    """Messages offset < number <= offset + limit, with has_more."""
    total = F.max("number").over(Window.partitionBy(session))
    return messages.withColumn("has_more", total > offset + limit).filter((F.col("number") > offset) & (F.col("number") <= offset + limit))


def selection_numbers(text: str, count: int | None = None) -> list[int]:
    """The numbers of a selection such as ``2,4-6``: sorted, each once."""
    chosen: set[int] = set()
    for part in text.split(","):
        ends = [x for x in part.strip().partition("-") if x != "-"]
        numbers = [int(x) for x in ends if x and x.isascii() and x.isdigit() and x[0] != "0"]
        if len(numbers) != 1 + ("-" in part):
            raise ValueError("A selection is numbers or ranges such as 2,4-6")
        if numbers != sorted(numbers) or (count is not None and numbers[-1] > count):
            raise ValueError(f"There is no message range {part.strip()}")
        chosen |= set(range(numbers[0], numbers[-1] + 1))
    return sorted(chosen)


def select_numbers(messages: DataFrame, text: str) -> DataFrame:
    return messages.filter(F.col("number").isin(selection_numbers(text)))


def excerpt(text: Column, start: int, end: int) -> Column:
    """Code points start <= i < end; null where the text is shorter than ``end``."""
    if not 0 <= start < end:
        raise ValueError("An excerpt needs 0 <= start < end")
    return F.when(F.length(text) >= end, F.substring(text, start + 1, end - start))


def sessions(turns: DataFrame, limit: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The sessions with most rows first (ties: the larger id first), how many there are, and whether more follow."""
    per = turns.groupBy(session).agg(F.count("*").alias("turns"), F.min_by("role", order).alias("first_role"))
    total = per.agg(F.count("*").alias("total"))
    head = per.orderBy(F.col("turns").desc(), F.col(session).desc()).limit(limit)
    return head.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > limit)  # one row


def day_headers(messages: DataFrame, stamp: str, session: str, order: list[str]) -> DataFrame:
    """day, clock, and header: whether the day differs from the last saved non-empty one of the session."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumn("day", F.coalesce(F.date_format(stamp, "yyyy-MM-dd"), F.lit(""))).withColumn("clock", F.coalesce(F.date_format(stamp, "HH:mm"), F.lit("")))
    before = F.last(F.nullif("day", F.lit("")), True).over(w)
    return rows.withColumn("header", (F.col("day") != "") & ~F.col("day").eqNullSafe(before))


def version(rows: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """A session's digest over its rows' texts in order (ties by text), each followed by a line feed; a null text is empty.

    The rows of a session pass by as a stream, so one of any length takes no more memory than a batch.
    """
    kind = dict(rows.dtypes)[session]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for b in bounded(batches, 1):
            ids, digests = [], []
            for row, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest is None or row != at:
                    if digest is not None:
                        ids.append(at)
                        digests.append(digest.hexdigest())
                    at, digest = row, hashlib.sha256()
                digest.update(f"{body}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(digests, pa.string())], names=[session, "version"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], b.schema.field(0).type), pa.array([digest.hexdigest()])], names=[session, "version"])

    said = rows.select(session, F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(order).alias("o"))
    ordered = said.repartition(session).sortWithinPartitions(session, "o", "t").select(session, "t")
    return ordered.mapInArrow(folded, f"`{session}` {kind}, version string")


def latest(rows: DataFrame, session: str, stamp: str, limit: int) -> DataFrame:
    """The sessions changed last (ties: the larger id first): their last stamp, rows, how many sessions there are, and whether more follow."""
    per = rows.groupBy(session).agg(F.max(stamp).alias("modified_at"), F.count("*").alias("turns"))
    head = per.orderBy(F.col("modified_at").desc(), F.col(session).desc()).limit(limit)
    total = rows.agg(F.count_distinct(session).alias("total"))
    return head.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > limit)  # one row
