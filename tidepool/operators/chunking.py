"""Splitting notes into passages that can be addressed by line: a fold over lines, run on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.batches import bounded

# The most characters of a passage, and the least length of a piece that isn't carried over.
PASSAGE, CARRIED = 1600, 200
_QUOTE, _FENCE, _HEADING = re.compile(r"^(?:> ?)+"), re.compile(r"`{3,}|~{3,}"), re.compile(r"#{1,6}\s+(.+)")


@dataclass
class Passage:
    text: str
    start: int
    end: int
    heading: str


def pieces(body: str, first_line: int) -> Iterator[tuple[int, str]]:
    """(line, piece): lines with their ends, cut to PASSAGE characters."""
    for n, line in enumerate(body.splitlines(keepends=True), first_line):
        for at in range(0, len(line), PASSAGE):
            yield n, line[at : at + PASSAGE]


def sections(body: str, first_line: int) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """(heading, pieces) of each section. Within a fence nothing is a heading; a fence ends at its own character."""
    heading, rows, fence = "", [], ""
    for n, piece in pieces(body, first_line):
        bare = _QUOTE.sub("", piece).strip()
        if not fence and (head := _HEADING.match(bare)):
            yield heading, rows
            heading, rows = head[1], []
        rows.append((n, piece))
        if mark := _FENCE.match(bare):
            char = mark[0][0]
            fence = {"": char, char: ""}.get(fence, fence)
    yield heading, rows


def windows(sizes: list[int]) -> Iterator[slice]:
    """Greedy runs of at most PASSAGE characters; a run begins with the one before's last piece if that is short."""
    start, stop = 0, 1
    while start < len(sizes):
        room = PASSAGE - sum(sizes[start:stop])
        while stop < len(sizes) and sizes[stop] <= room:
            room -= sizes[stop]
            stop += 1
        yield slice(start, stop)
        if stop == len(sizes):
            return
        start = stop - (sizes[stop - 1] < CARRIED)
        stop += 1


def split_body(body: str, first_line: int = 1) -> list[Passage]:
    """The passages of a note's body; blank ones are left out, but a note has one at least."""
    out = []
    for heading, rows in sections(body, first_line):
        for run in windows([len(p) for _, p in rows]):
            text = "".join(p for _, p in rows[run])
            if text.strip():
                out.append(Passage(text, rows[run][0][0], rows[run][-1][0], heading))
    return out or [Passage("", first_line, first_line, "")]


def split_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_ord, start_line, end_line, heading, text of every row's passages."""
    kind = dict(rows.dtypes)[key]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            out: list[tuple] = []
            for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(k, i, p.start, p.end, p.heading, p.text) for i, p in enumerate(split_body(body or ""))]
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=[key, "chunk_ord", "start_line", "end_line", "heading", "text"])

    return rows.select(F.col(key), F.col(text)).mapInArrow(split, f"{key} {kind}, chunk_ord int, start_line int, end_line int, heading string, text string")
