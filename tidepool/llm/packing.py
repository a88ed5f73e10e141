"""Best-fit packing by exact-complement hashing.

Documents are tokenised (each distinct word once per task, its ids reused), ended by id 0 and cut into
pieces of at most ``capacity`` tokens. Packing needs the lengths alone: their histogram has at most ``capacity`` rows.
On it, from the longest length down, the gap beside a length is looked up among single, pair and triple sums of the
lengths still available; what fills it exactly is consumed as often as the counts allow. The residual lengths go
best-fit, longest first. The plan is a short list of (length, rank range) -> (first sequence, offset); every piece finds
its place from its rank within its length. Ranks come from per-task counters and running sums over tasks, so no task
sees all pieces of a length.

Nulls: a null text is empty and becomes the single id 0; a null doc_id is kept. Repeated rows are packed one by one.
Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import chunks, gathered, only, staged, text_array, words_of

#: Distinct words whose ids a task remembers; it starts anew beyond that.
REMEMBERED = 500_000
#: Words that are encoded at a time, and text bytes that are cut at a time.
LEARNT, CUT_TEXT = 16_384, 4 << 20
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: The normaliser and the end of the splitting pattern under which words of Latin letters are known to keep their ids.
FOLDING, SPLITTING = [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)], r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN, _SMALL = "À-ÖØ-öø-ÿ", "ß-öø-ÿ"


class ChunkTokenizer:
    """Token ids of texts for tokenizers that never join across white space: each distinct word is encoded once.

    Where the tokenizer's own rules are those of ``FOLDING``, more is known of words of printable ASCII and Latin-1 letters
    that can't hold a special token (all are composed, and none changes beside another): a word has the ids of its lower
    case; with punctuation after its last letter or digit, the ids of both parts; and one of letters alone passes the
    normaliser and the splitting unchanged, so that a tokenizer without them is enough. Each depends on the word alone.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.tokenizer, self.bare, self.remembered = Tokenizer.from_file(path), None, remembered
        normal, cuts = rules.get("normalizer") or {}, (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        steps = [(x.get("type"), x.get("pattern")) for x in normal.get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex", "") for x in cuts if x.get("type") == "Split"]
        self.special = {x["content"][:2] for x in rules.get("added_tokens", [])}
        if steps == FOLDING and len(split) == 1 and split[0].endswith(SPLITTING) and all(len(x) == 2 and not x.isalnum() for x in self.special):
            rules["normalizer"], rules["pre_tokenizer"]["pretokenizers"] = None, [x for x in cuts if x.get("type") != "Split"]
            self.bare = Tokenizer.from_str(json.dumps(rules))
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {"": 0}
        self.ids, self.lengths, self.used = np.zeros(1 << 20, dtype=np.uint32), np.zeros(1 << 18, dtype=np.int32), 0

    def _learn(self, fresh: list[str], tokenizer) -> None:  # noqa: ANN001
        encoded = tokenizer.encode(fresh, is_pretokenized=True, add_special_tokens=False)
        ids, n = np.array(encoded.ids, dtype=np.uint32), len(self.seen)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(fresh) > len(self.lengths):
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + len(fresh)] = np.bincount(np.array(encoded.word_ids, dtype=np.int64), minlength=len(fresh)) if len(ids) else 0
        self.used += len(ids)
        self.seen.update(zip(fresh, range(n, n + len(fresh)), strict=True))

    def parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Two words for each word, the second often empty, whose ids in a row are the word's."""
        none = pa.array([""] * len(words), pa.string())
        if self.bare is None:
            return words, none
        plain = pc.match_substring_regex(words, rf"^[!-~{_LATIN}]+$")
        for x in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, x))
        words = pc.if_else(plain, pc.utf8_lower(words), words)
        # what follows the last letter or digit
        plain = pc.and_(plain, pc.match_substring_regex(words, rf"[a-z0-9{_LATIN}][!-/:-@\[-`{{-~]+$"))
        if not pc.any(plain).as_py():
            return words, none
        stem, at = pc.ascii_rtrim(words, characters=string.punctuation), plain.to_numpy(zero_copy_only=False)
        tails = np.full(len(words), "", dtype=object)
        tails[at] = pc.replace_substring_regex(words.filter(plain), rf"^.*[a-z0-9{_LATIN}]", "").to_numpy(zero_copy_only=False)
        return pc.if_else(plain, stem, words), pa.array(tails, pa.string())

    def _known(self, words: pa.Array) -> np.ndarray:
        """The number of each word, learnt first where it's new."""
        coded = words.dictionary_encode()
        values = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.seen.get, values, itertools.repeat(-1)), dtype=np.int64, count=len(values))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [values[i] for i in new.tolist()]
            bare = pc.match_substring_regex(pa.array(fresh, pa.string()), rf"^[a-z{_SMALL}]+$").to_pylist() if self.bare is not None else [False] * len(fresh)
            for tokenizer, kind in ((self.bare, True), (self.tokenizer, False)):
                own = list(itertools.compress(fresh, bare if kind else [not x for x in bare]))
                for s in range(0, len(own), LEARNT):
                    self._learn(own[s : s + LEARNT], tokenizer)
            at[new] = np.fromiter(map(self.seen.__getitem__, fresh), dtype=np.int64, count=len(fresh))
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``; and the offsets of the texts."""
        words = words_of(texts, lower=False)
        if len(self.seen) > self.remembered:
            self.forget()
        of = np.stack([self._known(x) for x in self.parts(words.values)], axis=1).reshape(-1)
        starts = np.zeros(len(self.seen) + 1, dtype=np.int64)
        np.cumsum(self.lengths[: len(self.seen)], out=starts[1:])
        # the ids of the batch's distinct words, and with them those of all words
        distinct, where = gathered(self.ids, starts[of], self.lengths[of].astype(np.int64))
        where = where[::2]
        body, ends = gathered(distinct, where[words.codes], np.diff(where)[words.codes])
        offsets = ends[words.offsets] + np.arange(len(texts) + 1)
        out = np.full(offsets[-1], end, dtype=np.uint32)
        inside = np.ones(len(out), dtype=bool)
        inside[offsets[1:] - 1] = False
        out[inside] = body
        return out, offsets


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: the task and the running number within part and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, counts = ChunkTokenizer(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in chunks(batches, limit=CUT_TEXT):
            ids, offsets = tokenizer.encode(text_array(b), end)
            whole = np.diff(offsets)
            per = -(-whole // capacity)
            doc = np.repeat(np.arange(len(whole)), per)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(whole[doc] - start, capacity)
            first, raw = offsets[doc] + start, memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            run = length[order]
            fresh = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, dtype=np.int64)
            nth = np.zeros(len(length), dtype=np.int64)
            nth[order] = np.arange(len(run)) - np.repeat(fresh, np.diff(np.r_[fresh, len(run)]))
            nth += counts[length]
            counts += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)], schema=_PIECE)

    return only(documents, doc_id="doc_id", text="text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, the lengths in each): every length as often as it's counted, in few sequences."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[int, list[int]]] = []

    def consume(lengths: list[int]) -> bool:
        values, needs = np.unique(lengths, return_counts=True)
        m = int((left[values] // needs).min())
        if m > 0:
            left[values] -= m * needs
            out.append((m, lengths))
        return m > 0

    def pair(gap: int, longest: int) -> Iterator[tuple[int, int]]:
        """Available a >= b with a + b = gap, the most even last."""
        a = np.arange(min(gap - 1, longest), (gap - 1) // 2, -1)
        for x in a[(left[a] > 0) & (left[gap - a] > 0)].tolist() if len(a) else []:
            yield x, gap - x

    for longest in range(capacity, 0, -1):
        if not left[longest]:
            continue
        gap = capacity - longest
        if not gap:
            consume([longest])
            continue
        if gap <= longest:
            consume([longest, gap])
        if left[longest]:
            for a, b in list(pair(gap, longest)):
                if not left[longest]:
                    break
                consume([longest, a, b])
        if left[longest]:
            for a in [int(x) for x in np.flatnonzero(left[: min(gap - 2, longest) + 1])[::-1]] if gap > 2 else []:
                if not left[longest]:
                    break
                if 3 * a < gap:
                    break
                for b, c in list(pair(gap - a, a)):
                    if not left[longest] or not left[a]:
                        break
                    consume([longest, a, b, c])
    # what has no exact complement: best fit, longest first
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    gaps = np.zeros(capacity + 1, dtype=np.int64)
    for longest in range(capacity, 0, -1):
        n = int(left[longest])
        while n:
            fits = np.flatnonzero(gaps[longest:])
            if len(fits):
                gap = int(fits[0]) + longest
                m, lengths = open_[gap].pop()
                gaps[gap] -= m
                if m > n:
                    open_[gap].append((m - n, lengths))
                    gaps[gap] += m - n
                    m = n
                open_.setdefault(gap - longest, []).append((m, [*lengths, longest]))
                gaps[gap - longest] += m
                n -= m
            else:
                each = min(capacity // longest, n)
                m = n // each
                open_.setdefault(capacity - each * longest, []).append((m, [longest] * each))
                gaps[capacity - each * longest] += m
                n -= m * each
    return out + [x for group in open_.values() for x in group]


def places(patterns: list[tuple[int, list[int]]], capacity: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """Per length: the first rank of each range, the sequence of that rank, and the offset."""
    used, ranges, first = [0] * (capacity + 1), [([], [], []) for _ in range(capacity + 1)], 0
    for m, lengths in patterns:
        offset = 0
        for n in lengths:
            for column, x in zip(ranges[n], (used[n], first, offset), strict=True):
                column.append(x)
            used[n] += m
            offset += n
        first += m
    return [tuple(np.array(c, dtype=np.int64) for c in r) if r[0] else None for r in ranges]


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = documents.sparkSession
    cut = staged(pieces(documents, tokenizer_path, capacity, end))
    counts = staged(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    where = spark.sparkContext.broadcast(places(plan(lengths, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.join(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*list(_PIECE)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(length[order]) > 0, True]) if len(order) else [0]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                at = order[s:e]
                begin, seq, off = where.value[length[at[0]]]
                k = np.searchsorted(begin, rank[at], side="right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - begin[k], off[k]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(put, _PLACED)
