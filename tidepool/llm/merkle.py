"""A Merkle manifest of a table: a tree of digests per language, one over their roots, and a proof for every row.

Superblock reduction: a node's place in its tree is cut into blocks of ``fanout ** levels`` nodes. ``applyInPandas``
collapses the levels of a block in one call, the blocks' roots are reduced in the same way until a tree has one node left,
and on the way down the lower part of a proof, within a block, is joined to the upper part, that of the block's root.
A group never holds more than ``fanout ** levels`` rows of a few digests, whatever the size of a language.

Rows: a null doc_id or language sorts first; rows that are equal are leaves of their own, side by side; a null column is
written as ``-``, so it differs from an empty one; an empty table has no row and no root. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import only, staged, unstage

FANOUT, LEVELS = 8, 4
#: Leaves that one task puts in order.
RANGE_ROWS = 200_000
#: Rows of (tree, partition) that are broadcast at most, some 60 bytes each; beyond that they are joined.
BROADCAST_RUNS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(*values: Column) -> Column:
    """The digest of a row: each value's UTF-8 size, a colon and the value, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def joined_digest(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def depth(n: int, fanout: int) -> int:
    """Levels between ``n`` nodes and the one that remains."""
    steps = 0
    while n > 1:
        n, steps = -(-n // fanout), steps + 1
    return steps


def collapse(nodes: list[str], steps: int, fanout: int) -> list[list[str]]:
    """The nodes, and those of each level above them."""
    out = [nodes]
    for _ in range(steps):
        nodes = [joined_digest(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def siblings(nodes: list[str], fanout: int) -> Iterator[tuple[str, bytes]]:
    """For each node the digests of the others in its run, and two bytes: its place and how many others there are."""
    for i in range(0, len(nodes), fanout):
        run = "".join(nodes[i : i + fanout])
        others = len(run) // 64 - 1
        for at in range(others + 1):
            yield run[: 64 * at] + run[64 * (at + 1) :], bytes((at, others))


@F.pandas_udf(T.StringType())
def fold(leaf: pd.Series, proof: pd.Series, shape: pd.Series) -> pd.Series:
    """The root that a leaf and a proof lead to."""

    def folded(h: str, others: str, places: bytes) -> str:
        start = 0
        for at, count in zip(places[::2], places[1::2], strict=True):
            run = others[start : start + 64 * count]
            h = joined_digest([run[: 64 * at], h, run[64 * at :]])
            start += 64 * count
        return h

    return pd.Series([folded(*x) for x in zip(leaf, proof, shape, strict=True)], dtype=object)


def _in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, the place within the row's tree from 0, and n, the tree's size.

    Ranges of rows are sorted by as many tasks; what a range has of each tree is counted, and only these counts are summed
    up. The sorted ranges are a written table, so places stay the same when an executor is lost.
    """
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    dealt = staged(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    runs = staged(runs.select("tree", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(of_tree).alias("n")))
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    placed = dealt.join(runs, ["tree", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n")
    out = staged(placed)
    unstage(dealt)
    return out


def _rise(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of these blocks' blocks and so on; of the last, a tree has one node.

    ``nodes``: tree, idx, n, h. A block is one group.
    """
    span, out = fanout**levels, [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0

    def root_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        held = [h.hex() for h in rows.sort_values("idx")["h"]]
        root = collapse(held, min(levels, depth(n, fanout)), fanout)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n // span)], "h": [bytes.fromhex(root)]})

    while True:
        blocks = out[-1].select("tree", F.expr(f"idx div {span}").alias("block"), "idx", "n", "h").groupBy("tree", "block")
        out.append(staged(blocks.applyInPandas(root_of, "tree string, idx long, n long, h binary")))
        if most <= span:
            return out
        most = -(-most // span)


def _prover(carried: list[str], fanout: int, levels: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The rows of a block with their proofs: within the block, then that of the block's root, which is the row above."""

    def proven(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        held = collapse([h.hex() for h in rows["h"]], min(levels, depth(int(rows["n"].iloc[0]), fanout)), fanout)
        parts = [list(siblings(level, fanout)) for level in held[:-1]]
        top = above.iloc[0]
        out = rows[["tree", "idx", "h", *carried]].copy()
        steps = [[part[i // fanout**k] for k, part in enumerate(parts)] for i in range(len(rows))]
        out["proof"] = ["".join([s[0] for s in x] + [top["proof"]]) for x in steps]
        out["shape"] = [b"".join([s[1] for s in x] + [top["shape"]]) for x in steps]
        out["subroot"], out["root"] = top["subroot"], top["root"]
        return out

    return proven


def _descend(risen: list[DataFrame], tops: DataFrame, carried: list[str], fanout: int, levels: int) -> DataFrame:
    """tree, idx, h, the carried columns, proof, shape, subroot and root of the first table's nodes.

    ``tops``: tree, proof, shape, subroot, root of the last table's nodes.
    """
    span = fanout**levels
    above = risen[-1].select("tree", "idx").join(tops, "tree")
    for nodes in reversed(risen[:-1]):
        more = carried if nodes is risen[0] else []

        types = "".join(f", `{c}` string" for c in more)
        blocks = nodes.withColumn("block", F.expr(f"idx div {span}")).groupBy("tree", "block")
        pairs = blocks.cogroup(above.withColumnRenamed("idx", "block").groupBy("tree", "block"))
        found = pairs.applyInPandas(_prover(more, fanout, levels), f"tree string, idx long, h binary{types}, proof string, shape binary, subroot string, root string")
        above = found if nodes is risen[0] else staged(found.drop("h"))
    return above


def manifest(documents: DataFrame, claims: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, claimed, subroot, root, proof, shape of every row; ``fold(leaf, proof, shape)`` is the root again.

    ``proof`` has the digests of the siblings from the leaf's level up to the root's, left to right, and ``shape`` two bytes a
    level: the node's place in its run and the number of siblings. ``claims`` is a digest over the columns doc_id, source,
    lang, n_chars and text that is carried along as ``claimed`` (else null), to be held against the manifest.
    """
    kind = dict((c.lower(), t) for c, t in documents.dtypes)["doc_id"]
    rows = only(documents, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    leaf = leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    claimed = F.lit(None).cast("string") if claims is None else claims
    leaves = staged(rows.select(tree.alias("tree"), "doc_id", F.unhex(leaf).alias("h"), claimed.alias("claimed")))
    placed = _in_order(leaves, ["doc_id", "h"]).withColumn("doc_id", F.col("doc_id").cast("string"))
    unstage(leaves)
    risen = _rise(placed, fanout, levels)
    roots = risen[-1].select(F.lit("").alias("tree"), F.col("tree").alias("language"), "h")
    languages = _rise(_in_order(roots, ["language"]), fanout, levels)
    top = F.lower(F.hex("h"))
    tops = languages[-1].select("tree", F.lit("").alias("proof"), F.lit(b"").alias("shape"), F.lit("").alias("subroot"), top.alias("root"))
    tops = _descend(languages, tops, ["language"], fanout, levels)
    tops = staged(tops.select(F.col("language").alias("tree"), "proof", "shape", top.alias("subroot"), "root"))
    out = _descend(risen, tops, ["doc_id", "claimed"], fanout, levels)
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), top.alias("leaf"), "claimed", "subroot", "root", "proof", "shape")


def tampered_leaf() -> Column:
    """The leaf of a row whose text has its A-Z in lower case, where 3 divides the crc32 of its id; else the row's own."""
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)


def verified_manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest held against a tampered copy of the table."""
    m = manifest(documents, tampered_leaf()).withColumn("folded_root", fold("claimed", "proof", "shape"))
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
