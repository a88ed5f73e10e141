"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import hashlib
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import chat_format, common, edit_fingerprint, jaccard_join, lang_id, line_dedup, lm_score, mixing, packing, substring_dedup, topk
from tidepool.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def collected(df, *columns):
    return sorted((tuple(x[c] for c in columns) for x in df.collect()), key=repr)


def test_chunks_and_words():
    import pyarrow as pa

    texts = pa.array(["a b", None, "", " \x0b c d\n", "é" * 50, "x"])
    b = pa.RecordBatch.from_arrays([texts], names=["text"])
    for limit in (1, 7, 60, 10_000):
        parts = list(common.chunks(iter([b, b.slice(0, 0), b]), limit=limit))
        assert [t for p in parts for t in p.column(0).to_pylist()] == texts.to_pylist() * 2
    flat = pa.array([t or "" for t in texts.to_pylist()])
    want = [WORD.findall(t) for t in flat.to_pylist()]
    w = common.words_of(flat, lower=False)
    named = np.array(w.values.to_pylist(), dtype=object)[w.codes]
    assert [list(named[s:e]) for s, e in zip(w.offsets[:-1], w.offsets[1:], strict=True)] == want
    assert common.count_words(flat.slice(1)).tolist() == [len(x) for x in want[1:]]


def test_sieve(spark):
    known = spark.range(0, 3000, 3).select(F.col("id").alias("h"))
    sieve = common.Sieve.of(known, "h")
    hit = sieve.test(np.arange(3000, dtype=np.uint64))
    assert hit[::3].all() and hit.mean() < 0.4
    assert not common.Sieve.of(known.limit(0), "h").test(np.arange(9, dtype=np.uint64)).any()


@pytest.mark.parametrize("broadcast_bytes", [1 << 27, 3000])
def test_lm_score(documents, rows, broadcast_bytes):
    out = lm_score.score(documents, broadcast_bytes=broadcast_bytes, segments=8)
    counts = collections.Counter()
    tokens = [([*WORD.findall((r[1] or "").translate(LOWER)), None], r[0]) for r in rows]
    kept = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0
    for t, i in tokens:
        if kept(i):
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, not kept(i), len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)) for t, i in tokens), key=repr)
    got = out.withColumn("base_score", F.round("base_score", 6))
    assert collected(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == want
    assert out.filter("score > 0 or isnan(score)").count() == 0


def test_lm_score_is_the_models(documents, rows):
    """Against a plain model with dictionaries of exact counts cut to their levels: the filter may only add a little to some counts."""
    tokens = {i: [(x, y) for x, y in zip(w, [None, *w], strict=False)] for i, w in ((r[0], [*WORD.findall((r[1] or "").translate(LOWER)), None]) for r in rows)}
    kept = [i for r in rows for i in (r[0],) if zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0]
    words, pairs = collections.Counter(), collections.Counter()
    for i in kept:
        words.update(x for x, _ in tokens[i])
        pairs.update(tokens[i])
    n, v = sum(words.values()), len(words)
    mid = lambda c, base: float(lm_score.level_count(lm_score.levels_of(np.array([c]), base), base)[0]) if c else 0.0
    want = {}
    for i, t in tokens.items():
        want[i] = 0.0
        for x, y in t:
            c, context = mid(words[x], 1.25), mid(words[y], 1.25)
            pair = min(mid(pairs[x, y], 2.0), context)
            want[i] += math.log10((pair + 4.0 * (c + 0.1) / (n + 0.1 * (v + 1))) / (context + 4.0))
    got = {x["doc_id"]: x["score"] for x in lm_score.score(documents, segments=4).collect()}
    apart = np.array([abs(got[i] - want[i]) / len(t) for i, t in tokens.items()])
    assert set(got) == set(want) and apart.mean() < 0.02 and np.median(apart) < 0.01
    assert np.corrcoef([got[i] for i in want], list(want.values()))[0, 1] > 0.999


def test_lm_score_beyond_a_broadcast(documents):
    """The segments' holders give what a broadcast filter gives."""
    a = collected(lm_score.score(documents, segments=8).withColumn("score", F.round("score", 9)), "doc_id", "score")
    b = collected(lm_score.score(documents, segments=8, broadcast_bytes=2000).withColumn("score", F.round("score", 9)), "doc_id", "score")
    assert a == b


def test_bloom_levels():
    r = np.random.default_rng(1)
    h, n = r.integers(0, 1 << 63, 5000).astype(np.uint64), r.geometric(0.01, 5000)
    levels = lm_score.levels_of(n, 2.0)
    bits = np.frombuffer(lm_score.Filter.build([(h, levels)]), dtype=np.uint8)
    f = lm_score.Filter({0: (bits, np.zeros(0, np.uint64), np.zeros(0, np.int64))}, 1)
    got = f.levels(h)
    assert (got >= levels).all() and (got == levels).mean() > 0.9
    assert (f.levels(r.integers(0, 1 << 63, 5000).astype(np.uint64)) > 0).mean() < 0.05


def brute_targets(sizes):
    left, share, target = dict(sizes), 1.5 * sum(sizes.values()), {}
    order = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [k for k in sizes if k is None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    while left:
        total = sum(weight[k] for k in left)
        over = [k for k in left if share * weight[k] / total > 2 * left[k]]
        if not over:
            return target | {k: share * weight[k] / total for k in left}
        for k in over:
            target[k] = 2.0 * left.pop(k)
            share -= target[k]
    return target


@pytest.mark.parametrize("group_rows", [50_000, 7])
def test_mixing(documents, rows, group_rows):
    out = mixing.mix_sources(documents, group_rows=group_rows)
    got = [x.asDict() for x in out.collect()]
    size = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    assert sorted((x["doc_id"], x["size"]) for x in got if x["doc_id"] is not None) == sorted((r[0], size(r[1])) for r in rows if r[0] is not None)
    assert len(got) == len(rows)
    taken = collections.Counter()
    for x in got:
        assert x["target"] == pytest.approx(want[x["source"]]) and x["source_size"] == sizes[x["source"]]
        assert x["taken"] in (0, x["size"], 2 * x["size"])
        taken[x["source"]] += x["taken"]
    largest = max(x["size"] for x in got)
    assert all(abs(taken[k] - want[k]) <= largest for k in want)
    assert collected(out, "doc_id", "taken") == collected(mixing.mix_sources(documents, group_rows=group_rows), "doc_id", "taken")


def test_mixing_keeps_expectations():
    import pandas as pd

    n = 40
    base = pd.DataFrame({"doc_id": range(n), "row": 0, "source": "a", "size": [400, 300] + [10] * (n - 2), "source_size": 1, "target": 1.0, "salt": 0, "whole": 0, "p": 0.3, "done": False})
    mean = np.mean([mixing._round(base.copy(), True, seed, 0).sort_values("doc_id")["p"].to_numpy() for seed in range(400)], axis=0)
    assert abs(mean - 0.3).max() < 0.12 and abs(mean.mean() - 0.3) < 0.02


def test_repeat_by_copies(documents, rows):
    mixed = mixing.mix_sources(documents).cache()
    out = mixing.repeat_by_copies(documents, mixed)
    assert out.columns == documents.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize(("chunk", "group"), [(3 << 20, 1024), (2000, 1024), (2000, 2)])
def test_substring_dedup(documents, rows, chunk, group, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_TEXT", chunk)
    monkeypatch.setattr(substring_dedup, "GROUP_CHUNKS", group)
    out = substring_dedup.dedup_substrings(documents)
    key = lambda i: -1 if i is None else i
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: key(x[0])):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), key(i))
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < key(i):
                gone[p : p + 13] = [True] * 13
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert collected(out, "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 100


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50), (1, 35), (2, 20)])
def test_jaccard_join(documents, rows, size, percent):
    out = jaccard_join.join_components(documents, size, percent)
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append((r[0], frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)) if w else frozenset()))
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    key = lambda i: -1 if i is None else i
    least = {}
    for (i, _), g in zip(sets, group, strict=True):
        least[g] = min(key(i), least.get(g, 1 << 60))
    want = [(i, len(s), (least[g] if least[g] >= 0 else None) if s else i) for (i, s), g in zip(sets, group, strict=True)]
    assert collected(out, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_jaccard_of_unequal_sizes(spark):
    """A set and one of several times its size may be linked at a low percentage; the sketch's tree gives the plain sum."""
    r = np.random.default_rng(4)
    rows = []
    for k, part in enumerate((1.0, 0.31, 0.22, 0.5, 0.12)):
        words = [f"w{k}x{i}" for i in range(130)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(r.permutation(words)[: int(130 * part)]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for percent, linked in ((20, {0, 1, 2, 3}), (30, {0, 1, 3}), (60, {0})):
        got = jaccard_join.join_components(d, 1, percent).filter("doc_id <> component_id").collect()
        assert {x["component_id"] // 2 for x in got} == linked
    scanned = jaccard_join._scanned(common.only(d, doc_id="doc_id", text="text"), 1).cache()
    plain = np.zeros(jaccard_join.COUNTERS, dtype=np.int64)
    for x in scanned.filter("segment >= 0").collect():
        plain.reshape(jaccard_join.SEGMENTS, -1)[x["segment"]] += np.frombuffer(bytes(x["counters"]), np.uint32)
    jaccard_join.FAN_IN, was = 2, jaccard_join.FAN_IN
    assert (jaccard_join._counters(scanned, 7) == plain).all() and plain.sum() > 0
    jaccard_join.FAN_IN = was


CLASHING = ["cuts", "own_id", "own_text", "own_row", "row", "whole", "gone_key", "gone_own", "own", "n", "h", "body", "first", "line_dedup", "__cuts", "__gone", "component_id", "n_shingles", "copies", "copy", "m_id", "m_row", "size", "lang_pred", "score", "a.b"]


@pytest.mark.parametrize("make", [line_dedup.dedup_lines, jaccard_join.keep_one])
def test_clashing_columns(documents, make):
    """The rows are the same whatever else the table's columns are named, and those columns keep their values."""
    extra = documents.select("doc_id", "text", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHING])
    out = make(extra)
    kept = [c for c in CLASHING if make is jaccard_join.keep_one or c != "line_dedup"]
    assert [c for c in out.columns if c != "line_dedup" or c in kept] == ["doc_id", "text", *kept]
    assert collected(out, "doc_id", "text") == collected(make(documents.select("doc_id", "text")), "doc_id", "text")
    assert all(x[c] == f"{c}{'?' if x['doc_id'] is None else x['doc_id']}" for x in out.collect() for c in kept)


def test_jaccard_blocks_and_failures(documents, monkeypatch):
    """Tiny blocks, and short tokens that let wrong pairs through, give the same components."""
    want = collected(jaccard_join.join_components(documents, 3, 90), "doc_id", "component_id")
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join.Group, "alike", lambda self, i, j: self.rows[j][0] not in self.rows[i][8] and self.rows[i][0] not in self.rows[j][8])
    monkeypatch.setattr(jaccard_join, "parity_bits", lambda u, each=4: bytes(8))
    assert collected(jaccard_join.join_components(documents, 3, 90), "doc_id", "component_id") == want


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 1), (8, 7), (7, 2), (20, 21), (21, 22), (22, 20)]
    got = collected(jaccard_join.components(spark.createDataFrame(edges, "a long, b long")), "node", "comp")
    assert got == sorted([(1, 1), (3, 1), (4, 1), (5, 1), (2, 2), (7, 2), (8, 2), (9, 2), (20, 20), (21, 20), (22, 20)], key=repr)


def test_keep_one(documents, rows):
    out = jaccard_join.keep_one(documents)
    assert out.columns == documents.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and {r[0] for r in rows if not (r[1] or "").strip()} <= set(ids)


def test_keep_one_by_row(spark):
    base = [" ".join(f"w{k}x{i * i}" for i in range(40)) for k in range(4)]
    near = lambda k, end: f"{base[k]} {end}"
    rows = [(1, base[0]), (5, near(0, "a")), (5, base[1]), (5, base[1]), (None, base[2]), (None, near(2, "b")), (None, near(2, "c")), (None, base[3]), (7, near(2, "d")), (8, ""), (8, None), (None, "")]
    rows += [(9, near(0, "e")), (1, near(0, "f"))]
    got = [tuple(r) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    first = [x for x in got if x[1] and x[1].startswith(base[0])]
    third = [x for x in got if x[1] and x[1].startswith(base[2])]
    assert [i for i, _ in first] == [1] and [i for i, _ in third] == [None]
    assert sorted(map(repr, set(got) - {*first, *third})) == sorted(map(repr, [(5, base[1]), (None, base[3]), (8, ""), (8, None), (None, "")]))
    assert len(got) == len(set(got))


def test_packing(documents, rows):
    from tokenizers import Tokenizer

    path, capacity = tokenizer("word_bpe_49k.json"), 64
    got = collections.defaultdict(list)
    places = collections.defaultdict(list)
    for x in packing.pack(documents, path, capacity).collect():
        got[x["doc_id"]].append((x["piece"], x["start"], x["length"], x["ids_crc32"]))
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    t, want = Tokenizer.from_file(path), collections.defaultdict(list)
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[r[0]] += [(k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    tokens = sum(n for p in places.values() for _, n in p)
    assert len(places) <= -(-tokens // capacity) + 2


@pytest.mark.parametrize("remembered", [300, 500_000])
def test_chunk_tokenizer_is_the_tokenizer(remembered):
    """Combining marks, special tokens, controls, other blanks and contractions, in mixed batches: the same ids throughout."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    whole, own, r = Tokenizer.from_file(path), packing.ChunkTokenizer(path, remembered), np.random.default_rng(remembered)
    assert own.bare is not None
    atoms = [*"abcJTWHhÉéÀößÿÆŞİıſK.,12²½中🙂ςǅ-(_~<|>'", "\u030c", "\u0331", "\u0308", "\u030a", "\u0301", "\u0307", "'s", "'S", "'LL", "###", "<|", "|>", "<|endoftext|>", "endoftext"]
    atoms += ["\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "\x00", "\x01", "\x7f", "ΑΣ", "ﬁ", *" " * 6]
    texts = ["J\u030c", "H\u0331 T\u0308", "W\u030a", "", " ", *("".join(atoms[k] for k in r.integers(0, len(atoms), r.integers(0, 14))) for _ in range(50_000))]
    for s in range(0, len(texts), 400):
        part = texts[s : s + 400]
        ids, offsets = own.encode(pa.array(part, pa.string()), 0)
        want = [[*x.ids, 0] for x in whole.encode_batch(part, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want


def test_chunk_tokenizer_of_other_rules(tmp_path):
    """Where the tokenizer doesn't fold case, no word stands for another."""
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"]["normalizers"] = rules["normalizer"]["normalizers"][:2]
    (tmp_path / "t.json").write_text(json.dumps(rules), encoding="utf-8")
    own, texts = packing.ChunkTokenizer(str(tmp_path / "t.json")), ["Some Words, some words", "ÉTÉ été"]
    ids, _ = own.encode(pa.array(texts), 0)
    assert own.bare is None and ids.tolist() == [i for x in Tokenizer.from_file(str(tmp_path / "t.json")).encode_batch(texts, add_special_tokens=False) for i in [*x.ids, 0]]


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(3)
    for _ in range(20):
        counts = {int(n): int(c) for n, c in zip(r.integers(1, 51, 12), r.integers(1, 30, 12), strict=True)}
        used = collections.Counter()
        for m, lengths in packing.plan(counts, 50):
            assert m > 0 and sum(lengths) <= 50
            for n in lengths:
                used[n] += m
        assert used == counts


def test_chat(spark):
    path = tokenizer("byte_bpe_50k.json")
    tricky = "<|im_end|>\n<|im_start|>assistant <\\|x <\\\\| é🙂"
    rows = [(1, 0, "user", tricky, 1), (1, 1, "assistant", "ok\n", 1), (1, 1, "assistant", tricky, 1), (2, None, None, None, 1), (2, 5, "sys\ntem\\n", "x", 1), (None, 0, "assistant", "", 1), (3, 0, "assistant", "long " * 30_000, 1), (1, 0, "user", tricky, 1)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, said int").repartition(3)
    got = {x["conv_id"]: x for x in chat_format.digest(chat_format.format_turns(chat_format.with_probe(d), path), path).collect()}
    assert set(got) == {-1, 1, 2, 3, None}
    by = collections.defaultdict(list)
    for c, turn, role, text, _ in rows:
        by[c].append((-1 if turn is None else turn, hashlib.sha256(f"{role or ''}\n{text or ''}".encode()).hexdigest(), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        learnt = "".join(t for *_, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    t = chat_format.ChatTokenizer(path)
    first = chat_format.format_turns(d, path).filter("conv_id = 1 and turn = 0").first()
    shown = t.decode(first["token_ids"])
    assert shown.count(chat_format.START) == shown.count(chat_format.END) == 1
    assert chat_format.digest(chat_format.format_turns(d.limit(0), path), path).count() == 0


def test_chat_tokenizer_is_the_tokenizer():
    """Random texts of blanks, controls, contractions and special tokens: the same ids as the whole text's, and the text again."""
    path, r = tokenizer("byte_bpe_50k.json"), np.random.default_rng(13)
    t = chat_format.ChatTokenizer(path)
    atoms = [*"abXY19é中🙂.,'-<|>", "'s", "'ll", "<|endoftext|>", "<|im_start|>", "\u0301", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "\x00", *" " * 14, "  ", "word", "the"]
    texts = ["", " ", "a b", "a  b ", *("".join(atoms[k] for k in r.integers(0, len(atoms), r.integers(0, 16))) for _ in range(40_000))]
    for s in range(0, len(texts), 1000):
        part = texts[s : s + 1000]
        ids, offsets = t.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [x.ids for x in t.base.encode_batch(part, add_special_tokens=False)]
        assert [t.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == part
    some = r.integers(0, t.start, 5000).tolist()
    assert [t.decode(some[i : i + 5]) for i in range(0, 5000, 5)] == [t.base.decode(some[i : i + 5], skip_special_tokens=False) for i in range(0, 5000, 5)]


def brute_lines(rows):
    seen, out = set(), {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for r in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=key):
        lines, kept, n = r[1].split("\n"), [], 0
        for s, e in line_dedup.chunk_lines(lines):
            body = "\n".join(lines[s:e])
            if e - s >= 2 and sum(bool(x.strip()) for x in lines[s:e]) >= 2:
                if body in seen:
                    n += e - s
                    continue
                seen.add(body)
            kept += lines[s:e]
        out[r] = ("\n".join(kept), len(lines), n)
    return out


def test_line_dedup(documents, rows):
    out = line_dedup.dedup_lines(documents)
    assert out.columns == [*documents.columns, "line_dedup"]
    want = brute_lines(rows)
    texts = {r[0]: r[1] for r in rows}
    got = out.select("doc_id", "text", "line_dedup.*").collect()
    assert len(got) == len(rows)
    for x in got:
        t = texts[x["doc_id"]]
        assert (x["text"], x["n_lines"], x["n_removed"]) == ((None, 0, 0) if t is None else want[x["doc_id"], t])
    assert sum(x["n_removed"] for x in got) > 0


def test_line_chunks_resist_shifts():
    lines = [f"line {i * i}" for i in range(200)]
    a = {tuple(lines[s:e]) for s, e in line_dedup.chunk_lines(lines)}
    moved = ["new", *lines[:100], "inserted", *lines[100:]]
    b = {tuple(moved[s:e]) for s, e in line_dedup.chunk_lines(moved)}
    assert len(a - b) <= 4


def test_line_chunks_have_enough_text():
    r = np.random.default_rng(3)
    for n in range(2, 60):
        lines = [x for i in range(n) for x in (f"line {r.integers(1 << 40)}", *[""] * int(r.integers(0, 3)))]
        found = line_dedup.chunk_lines(lines)
        assert [x for s, e in found for x in lines[s:e]] == lines
        assert min(sum(bool(x.strip()) for x in lines[s:e]) for s, e in found) >= 2


def test_line_runs(spark):
    line = lambda k, i: f"line {k} {i * i}"
    shared = [line("shared", i) for i in range(24)]
    texts = [[line(d, i) for i in range(5)] + shared[:n] + [line(d, i) for i in range(9, 13)] for d, n in enumerate((24, 24, 20, 24, 16))]
    texts += [texts[1], [line("copy", i) for i in range(3)], [line("copy", i) for i in range(3)], [*texts[0][:3], "", *texts[0][3:]]]
    d = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(d, runs=True).select("doc_id", "text", "line_dedup.n_removed").collect()}
    assert got[0][1] == got[6][1] == 0
    for i, n in ((1, 24), (2, 20), (3, 24), (4, 16)):
        assert got[i] == ("\n".join(texts[i][:5] + texts[i][5 + n :]), n)
    assert got[5] == ("", 33) and got[7] == ("", 3)
    assert got[8][1] >= 30
    chunked = {r["doc_id"]: r["n"] for r in line_dedup.dedup_lines(d).select("doc_id", F.col("line_dedup.n_removed").alias("n")).collect()}
    assert chunked[5] == 33 and chunked[7] == 3 and all(chunked[i] <= got[i][1] for i in got)


def test_fingerprints(documents, rows):
    got = collections.defaultdict(list)
    for x in edit_fingerprint.compare_with_edited(documents, range_text=8000).collect():
        got[x["doc_id"]].append(x)
    order = sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in rows))
    for k, (none, i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        want = (len(t), hashlib.sha256(edit_fingerprint.edited(t, following).encode()).hexdigest())
        assert want in {(x["n_chars"], x["edited_sha256"]) for x in got[None if none else i]}
    assert sum(map(len, got.values())) == len(rows)
    prints = collections.defaultdict(set)
    for r in rows:
        prints[r[1] or ""] |= {x["fingerprint"] for x in got[r[0]] if x["n_chars"] == len(r[1] or "")}
    assert all(len(p) == 1 for p in prints.values())
    near = [x for v in got.values() for x in v if x["n_chars"] > 100]
    assert min(x["near_edited"] for x in near) > 0.4 and np.mean([x["near_next"] for x in near]) < 0.2
    assert all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for v in got.values() for x in v)


def test_walk_is_the_walk_by_steps():
    w = edit_fingerprint.Walk()
    moves = w.stay.reshape(edit_fingerprint.CLASSES, edit_fingerprint.PERIOD) == 1
    for text in ("", "a", "hello world " * 40, "é🙂" * 500):
        points, offsets = edit_fingerprint._points([text, text[::-1]])
        out, step = [], 0
        for c in w.classes(points[: len(text)]).tolist():
            held = 0
            while True:
                out.append("%x" % w.digit[c])
                moved = moves[c, step % edit_fingerprint.PERIOD]
                step, held = step + 1, held + 1
                if moved or held == 8:
                    break
        want = "".join(out[s] for s in w.samples.tolist() if s < len(out))
        assert edit_fingerprint.fingerprints(w, points, offsets)[0] == want


def test_near_pairs(spark, documents, rows):
    prints = edit_fingerprint.compare_with_edited(documents).select("doc_id", "fingerprint")
    pairs = edit_fingerprint.near_pairs(prints).collect()
    assert all(p["likeness"] >= 0.7 and p["a"] != p["b"] for p in pairs)
    assert any(50 <= p["a"] < 58 and 50 <= p["b"] < 58 for p in pairs)


def joined(nodes, pairs):
    """The smallest node that pairs reach from each node."""
    comp = {n: n for n in nodes}
    for a, b in pairs:
        lo, hi = sorted((comp[a], comp[b]))
        comp = {n: lo if c == hi else c for n, c in comp.items()}
    return comp


def hexed(r, n):
    return "".join("0123456789abcdef"[k] for k in r.integers(0, 16, n))


def brute_pairs(prints, least=0.7):
    items = sorted(prints.items())
    return [(a, b) for k, (a, x) in enumerate(items) for b, y in items[k + 1 :] if edit_fingerprint.likeness(x, y) >= least]


@pytest.mark.parametrize("block", [3, 2048])
def test_near_pairs_without_the_head(spark, monkeypatch, block):
    monkeypatch.setattr(edit_fingerprint, "BLOCK", block)
    r = np.random.default_rng(8)
    prints = {}
    for _ in range(6):  # all share octave 0, and so every bucket, with one that is like none of them
        opening = hexed(r, 24)
        for _ in range(5):
            rest = hexed(r, 16)
            for _ in range(int(r.integers(1, 4))):
                prints[len(prints)] = opening + rest[: int(r.integers(13, 17))]
    prints |= {1000 + i: prints[i] for i in range(0, 20, 3)}
    d = spark.createDataFrame([*prints.items(), (None, prints[4]), (None, ""), (5, prints[5])], "doc_id long, fingerprint string").repartition(3)
    got = edit_fingerprint.near_pairs(d).collect()
    assert {p["likeness"] for p in got if p["b"] is None} == {1.0}
    pairs = [(p["a"], p["b"]) for p in got if p["b"] is not None]
    assert len(set(pairs)) == len(pairs)
    assert all(a < b and edit_fingerprint.likeness(prints[a], prints[b]) >= 0.7 for a, b in pairs)
    want = joined(prints, brute_pairs(prints))
    assert joined(prints, pairs) == want and len(set(want.values())) > 20


def test_near_pairs_of_late_octaves_and_short_texts(spark):
    r = np.random.default_rng(9)
    prints = {}
    for octaves in (3, 9, 12, 16):  # other openings, the last two octaves alike
        ending = hexed(r, 48)
        prints |= {len(prints) + k: hexed(r, (octaves - 2) * 24) + ending for k in range(3)}
    for n in range(1, 24):  # one digit changed, added, or as many as may be
        x = hexed(r, n)
        for at in range(0, n, 4):
            prints[len(prints)] = x[:at] + ("0" if x[at] != "0" else "1") + x[at + 1 :]
        prints |= {len(prints): x, len(prints) + 1: x + "7", len(prints) + 2: x + "77777"}
        out = list(x)
        for at in r.choice(n, int(n * 0.28125), replace=False):
            out[at] = "8" if x[at] != "8" else "9"
        prints[len(prints)] = "".join(out)
    d = spark.createDataFrame(list(prints.items()), "doc_id long, fingerprint string").repartition(3)
    pairs = [(p["a"], p["b"]) for p in edit_fingerprint.near_pairs(d).collect()]
    want = joined(prints, brute_pairs(prints))
    assert joined(prints, pairs) == want and all(want[3 * k] == want[3 * k + 2] for k in range(4))


def test_near_pairs_of_texts(spark, documents):
    """Against all pairs: long texts, with other openings of the same length, with edits, copies of short ones; and the small documents."""
    r = np.random.default_rng(10)
    said = lambda n: "".join("etaoin shrdlu"[k] for k in r.integers(0, 13, n))
    texts = ["", "a", "b"]
    for n in (8, 20, 90, 700, 5000, 30_000, 60_000):
        for _ in range(3):
            x = said(n)
            texts += [x, x[:-1] + "!", x + "?", said(n // 16) + x[n // 16 :], x[: n // 3] + "edit" + x[n // 3 :], x]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for table, enough in ((d, 40), (documents.filter("doc_id is not null"), 5)):
        prints = edit_fingerprint.compare_with_edited(table).select("doc_id", "fingerprint").cache()
        known = {x["doc_id"]: x["fingerprint"] for x in prints.collect()}
        pairs = [(p["a"], p["b"]) for p in edit_fingerprint.near_pairs(prints).collect()]
        want = joined(known, brute_pairs(known))
        assert joined(known, pairs) == want and len(known) - len(set(want.values())) >= enough


def brute_top_k(v, k=10):
    rows = [(n, i, [math.floor(1024 * c) if abs(c) < 1e300 else int(c) * 1024 for c in x]) for n, (i, x) in enumerate(v) if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for n, i, x in rows:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for m, j, y in rows if m != n and len(x) == len(y))[:k]
            out += [(i, rank, j, str(-s)) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out, key=repr)


def test_likenesses_and_bands():
    r = np.random.default_rng(11)
    prints = [hexed(r, int(n)) for n in r.integers(0, 200, 60)] + ["", ""]
    prints += [x[: len(x) // 2] + hexed(r, len(x) - len(x) // 2) for x in prints]
    a, b = prints, [prints[k] for k in r.permutation(len(prints))]
    got = edit_fingerprint.likenesses(a + a, b + a)
    assert got.tolist() == pytest.approx([edit_fingerprint.likeness(x, y) for x, y in zip(a + a, b + a, strict=True)])
    # a sample agrees with the chance of the agreeing share of the weights
    x = hexed(r, 170)
    y = "".join(c if r.random() < 0.8 else "g" for c in x[:160])
    bands = edit_fingerprint.Bands(4000, 1)
    sampled = [h for _, h in (bands.of([x]), bands.of([y]))]
    w = edit_fingerprint.weights(170)
    share = sum(w[i] for i in range(160) if x[i] == y[i]) / w.sum()
    assert abs((sampled[0] == sampled[1]).mean() - share) < 0.03


def test_near_pairs_find_edited_texts(spark):
    """Recall over all pairs, by the components that links make: groups of six texts of 600 characters, eight edits each."""
    r, letters = np.random.default_rng(12), "etaoin shrdlu"
    texts = []
    for _ in range(40):
        base = [letters[k] for k in r.integers(0, 13, 600)]
        for _ in range(6):
            x = list(base)
            for _ in range(8):
                at, kind = int(r.integers(len(x))), r.integers(3)
                x[at : at + (kind > 0)] = [] if kind == 2 else [letters[r.integers(13)]]
            texts.append("".join(x))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    compared = edit_fingerprint.compare_with_edited(d).cache()
    known = {x["doc_id"]: x["fingerprint"] for x in compared.collect()}
    classes = {x["doc_id"]: x["near_class"] for x in edit_fingerprint.near_classes(compared).collect()}
    want = brute_pairs(known)
    assert len(want) > 150 and sum(classes[a] == classes[b] for a, b in want) / len(want) >= 0.95
    brute = joined(known, want)
    assert all(brute[i] == brute[c] for i, c in classes.items())


def test_near_classes_of_odd_rows(spark, documents, rows, nothing):
    """Null ids, copies, empty texts and further columns; every row is there once."""
    got = edit_fingerprint.fingerprint_documents(documents)
    found = got.collect()
    assert sorted(repr(x["doc_id"]) for x in found) == sorted(repr(r[0]) for r in rows)
    of = {x["doc_id"]: x["near_class"] for x in found}
    same = collections.defaultdict(set)
    for i, t in ((r[0], r[1] or "") for r in rows):
        same[t].add(i)
    for ids in same.values():
        assert len({of[i] for i in ids}) == 1 and of[min(ids, key=lambda i: (i is None, i))] is not None
    assert edit_fingerprint.fingerprint_documents(nothing).count() == 0
    one = edit_fingerprint.fingerprint_documents(documents.filter("doc_id is null")).collect()
    assert [(x["doc_id"], x["near_class"], round(x["near_next"], 6)) for x in one] == [(None, None, 1.0)]


def test_top_k(spark):
    r = np.random.default_rng(5)
    v = [(i, r.normal(size=6).tolist()) for i in range(450)]
    v += [(1000 + i, v[7][1]) for i in range(20)] + [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (None, [1.0] * 6), (2400, [1.0, 2.0]), (3, v[3][1]), (2500, []), (2500, []), (100, v[100][1]), (100, v[8][1])]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(4)
    got = topk.top_k(d)
    assert collected(got, "query_id", "rank", "vec_id", "exact_score") == brute_top_k(v)
    assert got.filter("cast(score as string) <> exact_score").count() == 0
    assert topk.top_k(d.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3e5, 1e12, 1e200, 1.7e308])
def test_top_k_of_large_components(spark, size):
    """Beyond 64 bits, beyond doubles, with a constant column and small components beside large ones."""
    r = np.random.default_rng(6)
    v = [(i, [*(r.normal(size=3) * size).tolist(), 5.0, float(r.normal())]) for i in range(150)]
    v += [(200 + i, [size * (1 + i * 2.0**-50), 0.0, 0.0, 5.0, 1.0]) for i in range(30)] if size < 1e308 else []
    v = [(i, [max(min(c, 1.7e308), -1.7e308) for c in x]) for i, x in v] + [(300, [1.0, 0.0, 0.0, 0.0, 0.0]), (400, [0.0] * 5)]
    got = topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3))
    assert collected(got, "query_id", "rank", "vec_id", "exact_score") == brute_top_k(v)
    for x in got.collect():
        assert x["score"] == min(max(int(x["exact_score"]), -(1 << 63)), (1 << 63) - 1)


def test_top_k_reads_few_files(spark):
    """One query: files whose vectors' bounds don't reach the threshold aren't opened."""
    rows = spark.range(4000).selectExpr("id as vec_id", "array(cast(id as float), float(1)) as embedding").repartitionByRange(8, "vec_id")
    file = topk.VectorFile.build(topk.valid_vectors(rows))
    near = file.rows_of(spark.createDataFrame([(r["row"],) for r in file.exact.filter("vec_id > 3990").collect()], "row long"))
    assert 1 <= len(near.inputFiles()) < len(file.exact.inputFiles()) == 8
    found = file.search(spark.createDataFrame([(None, -5, [2.0, 0.0])], "row long, vec_id long, e array<float>"), 3).collect()
    assert sorted((x["rank"], x["vec_id"], x["score"]) for x in found) == [(1, 3999, 2048 * 3999 * 1024), (2, 3998, 2048 * 3998 * 1024), (3, 3997, 2048 * 3997 * 1024)]


def test_sort_keys():
    r = np.random.default_rng(2)
    x = sorted([int(a) * 10 ** int(b) for a, b in zip(r.integers(-1000, 1000, 500), r.integers(0, 600, 500), strict=True)] + [0, 1, -1])
    assert [topk.sort_key(i) for i in x] == sorted(topk.sort_key(i) for i in x)


def test_gradients_of_the_network():
    r = np.random.default_rng(0)
    net = lang_id.Network.new(["a", "b"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = r.integers(0, 256, (5, 3, lang_id.STRIDE)).astype(np.uint8), np.array([0, 1, 1])
    _, g = net.gradients(x, y)
    for k, v in net.weights.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        v[at] += 1e-3
        up = net.gradients(x, y)[0]
        v[at] -= 2e-3
        down = net.gradients(x, y)[0]
        v[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[k][at], rel=2e-2, abs=1e-4)


def test_labels_are_the_networks(spark, data):
    """Whole texts, window by window and each by itself, against the batched run."""
    import pyarrow as pa

    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").filter("text is not null").orderBy("doc_id").limit(25).collect()]
    texts += ["", "a", "é", "über " * 400, "x" * lang_id.WINDOW, "y" * (lang_id.WINDOW + 1)]
    net = lang_id.Network.new(["en", "de", "fr"], seed=4)
    want = []
    for t in texts:
        raw, each, total = np.frombuffer(t.encode(), np.uint8), lang_id.WINDOW * lang_id.STRIDE, np.zeros(3)
        for s in range(0, len(raw), each):
            part = raw[s : s + each]
            part = np.concatenate([part, np.zeros(-len(part) % lang_id.STRIDE, np.uint8)])
            total += net.probabilities(net.states(part.reshape(-1, 1, lang_id.STRIDE))[0]).sum(axis=(0, 1))
        want.append(total / max(1, -(-len(raw) // lang_id.STRIDE)))
    got = lang_id.label(net, pa.array(texts))
    assert np.abs(got - np.array(want)).max() < 1e-5


def test_language_id(spark, data, documents, nothing):
    d = spark.read.parquet(f"{data}/documents.parquet")
    out = lang_id.identify(d).join(d.select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out and lang is not null")
    assert held.filter("lang_pred = lang").count() / held.count() > 0.9
    odd = {r["doc_id"]: r for r in lang_id.identify(documents).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (60, 61, 62, 68))
    assert all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in odd.values())
    assert lang_id.identify(nothing).count() == 0
    unlabelled = lang_id.identify(documents.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.filter("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("make", [lm_score.score, mixing.mix_sources, substring_dedup.dedup_substrings, jaccard_join.join_components, lambda d: packing.pack(d, tokenizer("word_bpe_49k.json")), line_dedup.dedup_lines, edit_fingerprint.compare_with_edited, jaccard_join.keep_one])
def test_empty_tables(nothing, make):
    assert make(nothing).count() == 0


def test_staging_leaves_no_shuffle_files(spark):
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = kept(), spark.conf.get(name)
    summed = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    out = common.staged(summed.join(summed.withColumnRenamed("s", "t"), "k"))
    assert kept() <= before and spark.conf.get(name) == was
    assert out.count() == 10


def test_postings_grow_no_faster_than_passages(spark):
    # a passage in many texts stands out from chance, though it is rarer than a counter's mean
    h = np.arange(1, 50, dtype=np.uint64)
    counters = np.random.default_rng(3).poisson(1000, jaccard_join.COUNTERS)
    at = jaccard_join.Orders.counter(h)
    counters[at] += 400
    orders = jaccard_join.Orders(counters)
    assert (orders.level[at] > 0).all() and (orders.level > 0).mean() < 0.01
    # texts of too different sizes share no posting, those of like sizes do
    text = lambda n, k: " ".join([f"longsharedpassage{i}" for i in range(9)] + [f"w{k}x{i}" for i in range(n)])
    d = spark.createDataFrame([(i, text(n, i)) for i, n in enumerate([20, 21, 200, 2000, 2010])], "doc_id long, text string")
    postings = jaccard_join._groups(d, np.zeros(jaccard_join.COUNTERS, dtype=np.int64), 4, 3, 90).collect()
    sizes = {}
    for r in postings:
        sizes.setdefault(r["sig"], []).append(r["size"])
    assert sizes and all(x == [2, 2] for x in sizes.values())


def test_levels_are_looked_up_in_bounded_slices():
    import tracemalloc

    h = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 1 << 21, dtype=np.uint64))
    levels = 1 + (h % np.uint64(3)).astype(np.int64)
    bits = np.frombuffer(lm_score.Filter.build([(h, levels)]), dtype=np.uint8)
    f = lm_score.Filter({0: (bits, np.zeros(0, np.uint64), np.zeros(0, np.int64))}, 1)
    tracemalloc.start()
    got = f.levels(h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got >= levels).all() and (got == levels).mean() > 0.9
    assert peak < 2 * h.nbytes  # temporaries beside the result don't grow with what is asked
    assert len(f.levels(h[:0])) == 0


def test_keep_one_leaves_no_sets_on_disk(spark):
    folders = lambda: set(Path(common._session_dir(spark).removeprefix("file:")).glob("*"))
    before = folders()
    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    d = spark.createDataFrame([(1, text(1, 90)), (2, text(1, 92)), (3, text(2, 60)), (4, text(2, 60)), (5, "one")], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in jaccard_join.keep_one(d).collect()) == [1, 3, 5]
    left = [set(spark.read.parquet(str(p)).columns) for p in folders() - before]
    assert left and not any(c & {"sketch", "tokens", "component_id", "n_shingles"} for c in left)
