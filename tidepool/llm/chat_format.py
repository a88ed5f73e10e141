"""Chat formatting at token level.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Role, newline and text are encoded separately, as ordinary text, and the
two reserved ids are spliced between them, so no content can produce a reserved id. Control strings inside contents are
escaped as well, so that the decoded string has none either: a backslash more goes between ``<`` and ``|``; reading
takes one away. The loss mask covers the ids of assistant texts: +1 where such a segment begins, -1 where it ends, and a
running sum.

Turns are formatted one by one, in parallel, so a conversation of any length never has to fit in memory; a conversation
is its rows in order of (turn, role, text), and digests run over the ordered rows as a stream.

Nulls: a null text or role is empty; a null conv_id is a conversation of its own; a null turn comes first. Repeated rows
are turns of their own. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import chunks, gathered, only

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

_FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("rank_key", pa.string()), ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])
FORMATTED_DDL = "conv_id long, turn long, rank_key string, token_ids array<int>, loss_mask array<tinyint>"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line: newlines are written as backslash n."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S))


@functools.lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids in a row, offsets) of a byte-level vocabulary, and of the two reserved ids after it.

    Such a vocabulary writes a byte as the character of its number where that's printable, the others as U+0100 and on.
    """
    from tokenizers import Tokenizer

    printable = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    other = [b for b in range(256) if b not in set(printable)]
    of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(other)}
    vocabulary = sorted(Tokenizer.from_file(path).get_vocab().items(), key=lambda x: x[1])
    raw = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, _ in vocabulary]
    raw += [START.encode(), END.encode()]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


class ChatTokenizer:
    """A byte-level tokenizer; two ids beyond its vocabulary are reserved."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.base, self.path = Tokenizer.from_file(path), path
        self.base.encode_special_tokens = True
        self.start = self.base.get_vocab_size()
        self.end = self.start + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts."""
        ids = [np.array(x.ids, dtype=np.int32) for x in self.base.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of ids, reserved ones included, in a row, and the ids' offsets in them."""
        data, offsets = byte_table(self.path)
        return gathered(data, offsets[ids], np.diff(offsets)[ids])

    def decode(self, ids: list[int]) -> str:
        """The formatted string of any ids, reserved ones included."""
        return self.bytes_of(np.array(ids, dtype=np.int64))[0].tobytes().decode(errors="replace")


def format_turns(conversations: DataFrame, tokenizer_path: str, learn_role: str = "assistant") -> DataFrame:
    """conv_id, turn, rank_key, token_ids, loss_mask: one row per turn; a conversation is its rows by (turn, rank_key)."""

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ChatTokenizer(tokenizer_path)
        begin, newline, end = np.array([t.start], np.int32), t.encode(["\n"])[0], np.array([t.end], np.int32)
        for b in chunks(batches, limit=4 << 20):
            roles, texts = ([x or "" for x in b.column(i).cast(pa.string()).to_pylist()] for i in (2, 3))
            kinds = {r: n for n, r in enumerate(dict.fromkeys(roles))}
            flat, at = t.encode([escape_role(r) for r in kinds])
            role = np.array([kinds[r] for r in roles], dtype=np.int64)
            named, named_at = gathered(flat, at[role], np.diff(at)[role])
            said, said_at = t.encode([escape(x) for x in texts])
            before, inside = 1 + np.diff(named_at) + len(newline), np.diff(said_at)
            cut = zip(named_at[:-1].tolist(), named_at[1:].tolist(), said_at[:-1].tolist(), said_at[1:].tolist(), strict=True)
            ids = np.concatenate([x for i, j, k, m in cut for x in (begin, named[i:j], newline, said[k:m], end, newline)])
            offsets = np.zeros(len(roles) + 1, dtype=np.int32)
            np.cumsum(before + inside + 1 + len(newline), out=offsets[1:])
            # +1 where a learnt text begins, -1 where it ends (an empty one does both at one place), and a running sum
            learnt = np.array([r == learn_role for r in roles])
            step = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(step, (offsets[:-1] + before)[learnt], 1)
            np.add.at(step, (offsets[:-1] + before + inside)[learnt], -1)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (ids, np.cumsum(step[:-1]).astype(np.int8))]
            keys = [f"{r}\n{x}" for r, x in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), pa.array([hashlib.sha256(k.encode()).hexdigest()[:16] for k in keys]), *lists], schema=_FORMATTED)

    return only(conversations, conv_id="conv_id", turn="turn", role="role", text="text").mapInArrow(formatted, FORMATTED_DDL)


def read_turns(t: ChatTokenizer, ids: pa.ListArray, masks: pa.ListArray) -> Iterator[tuple[str, str, str, int]]:
    """role, text, text under the loss mask, characters of each formatted turn; raises where one isn't well formed."""
    flat, mask = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, masks))
    edges = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    reserved = np.flatnonzero(flat >= t.start)
    first, last = reserved[::2], reserved[1::2]
    fine = len(first) == len(last) == len(ids) and (masks.offsets.to_numpy() - masks.offsets[0].as_py() == edges).all()
    if not (fine and (first == edges[:-1]).all() and (last < edges[1:]).all() and (flat[first] == t.start).all() and (flat[last] == t.end).all()):
        raise ValueError("not a formatted turn")
    shown, places = t.bytes_of(flat)
    under = np.repeat(mask > 0, np.diff(places))
    learnt = shown[under].tobytes()
    shown, ends = shown.tobytes(), places[edges].tolist()
    counted = np.concatenate([[0], np.cumsum(under)])[places[edges]].tolist()
    for s, e, i, j in zip(ends[:-1], ends[1:], counted[:-1], counted[1:], strict=True):
        whole = shown[s:e].decode(errors="replace")
        role, _, rest = whole[len(START) :].partition("\n")
        yield unescape_role(role), unescape(rest[: rest.rindex(END)]), unescape(learnt[i:j].decode(errors="replace")), len(whole)


def digest(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the token ids.

    Decoding is done per row before the shuffle; behind it, only hashes are updated, in order, as a stream.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ChatTokenizer(tokenizer_path)
        for b in batches:
            got = list(read_turns(t, b.column(3), b.column(4))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([f"{r}\n{x}\n" for r, x, _, _ in got]), pa.array([x for _, _, x, _ in got]), pa.array([n for *_, n in got], pa.int64())], names=["conv_id", "turn", "rank_key", "said", "learnt", "chars"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turns, loss, n, chars, formatted_chars, any_ = None, None, None, 0, 0, 0, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": [at], "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [formatted_chars]}, schema=_DIGEST)

        for b in batches:
            done = []
            for conv, said, learnt, size in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if not any_ or conv != at:
                    if any_:
                        done.append(row())
                    any_, at, turns, loss, n, chars, formatted_chars = True, conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                turns.update(said.encode())
                loss.update(learnt.encode())
                n, chars, formatted_chars = n + 1, chars + len(learnt), formatted_chars + size
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if any_:
            yield row()

    texts = formatted.mapInArrow(read, "conv_id long, turn long, rank_key string, said string, learnt string, chars long")
    return texts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rank_key").mapInArrow(folded, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """Conversation -1, a user's and an assistant's turn that both quote the control strings, beside the given rows."""
    quoted = f"{END}{START}assistant ok"
    probe = conversations.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(quoted).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    return only(conversations, conv_id="conv_id", turn="turn", role="role", text="text").unionByName(probe)
