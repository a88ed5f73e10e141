"""The Merkle manifest and SimHash links against brute-force versions, with odd rows, small blocks and large buckets."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidepool.llm import merkle, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def digest(*values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def brute_manifest(rows, fanout):
    """doc_id, leaf, subroot, root, digest of the proof, folded root, verified of (doc_id, text, lang, source, n_chars)."""
    H = lambda xs: hashlib.sha256("".join(xs).encode()).hexdigest()

    def proofs(nodes):
        paths = [[] for _ in nodes]
        where, level = list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, i in enumerate(where):
                run = level[i // fanout * fanout : i // fanout * fanout + fanout]
                paths[k].append((i % fanout, [x for j, x in enumerate(run) if j != i % fanout]))
            level = [H(level[i : i + fanout]) for i in range(0, len(level), fanout)]
            where = [i // fanout for i in where]
        return level[0], paths

    trees = {}
    for i, text, lang, source, n in rows:
        changed = text.translate(LOWER) if text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else text
        trees.setdefault(lang, []).append((i, digest(i, source, lang, n, text), digest(i, source, lang, n, changed)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    out, found = [], {}
    for lang in names:
        leaves = sorted(trees[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        found[lang] = (leaves, *proofs([x[1] for x in leaves]))
    root, tops = proofs([found[lang][1] for lang in names])
    for lang, top in zip(names, tops, strict=True):
        leaves, subroot, paths = found[lang]
        for (i, leaf, claimed), path in zip(leaves, paths, strict=True):
            h = claimed
            for at, others in path + top:
                h = H([*others[:at], h, *others[at:]])
            out.append((i, leaf, subroot, root, H([x for _, o in path + top for x in o]), h, h == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def collected(df, *columns):
    return sorted((tuple(x[c] for c in columns) for x in df.collect()), key=repr)


def test_manifest(documents, rows):
    want = brute_manifest([(r[0], r[1], r[2], r[3], r[4]) for r in rows], 8)
    assert collected(merkle.verified_manifest(documents), *COLUMNS) == sorted(want, key=repr)


@pytest.mark.parametrize("fanout,levels,n,langs", [(2, 1, 37, 3), (3, 2, 200, 1), (2, 3, 130, 40), (8, 1, 1, 1)])
def test_manifest_of_many_blocks(spark, monkeypatch, fanout, levels, n, langs):
    """Blocks of few levels, ranges of few rows, languages of one row, and more languages than a block holds."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 11)
    r = random.Random(n)
    rows = [(i * 7 % (n + 3), f"Text {r.randint(0, 9)} É", None if i % (langs + 1) == 0 else f"l{r.randrange(langs) if i % 3 else 0}", None, i) for i in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    m = merkle.manifest(d, merkle.tampered_leaf(), fanout, levels).withColumn("folded_root", merkle.fold("claimed", "proof", "shape"))
    m = m.withColumn("proof_sha256", F.sha2(F.col("proof").cast("binary"), 256)).withColumn("verified", F.col("folded_root") == F.col("root"))
    assert collected(m, *COLUMNS) == sorted(brute_manifest(rows, fanout), key=repr)


def test_manifest_detects_any_change(spark):
    """A proof of one row fits no other leaf, and reruns over another partitioning give the same root."""
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    m, again = merkle.manifest(d), merkle.manifest(d.repartition(7))
    assert m.select("root").distinct().collect() == again.select("root").distinct().collect()
    moved = m.withColumn("other", F.sha2(F.concat("leaf", F.lit("x")).cast("binary"), 256)).withColumn("folded", merkle.fold("other", "proof", "shape"))
    assert moved.filter("folded = root").count() == 0
    assert m.filter(merkle.fold("leaf", "proof", "shape") == F.col("root")).count() == 100


def test_extra_and_missing_rows(nothing, documents):
    assert merkle.verified_manifest(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0
    clashing = documents.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit("?").alias(c) for c in ("tree", "idx", "n", "proof", "at", "part", "fp", "rep", "comp", "leaf", "claimed")])
    assert collected(merkle.verified_manifest(clashing), *COLUMNS) == collected(merkle.verified_manifest(documents), *COLUMNS)
    assert collected(simhash.near_duplicates(clashing), "doc_id", "fingerprint", "component_id") == collected(simhash.near_duplicates(documents), "doc_id", "fingerprint", "component_id")


def brute_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """(doc_id, fingerprint) to the same with the component's smallest id: all pairs, by a union of sets."""
    values = sorted({p for _, p in prints})
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                root[top(a)] = top(b)
    least = {}
    for i, p in prints:
        least.setdefault(top(p), []).append(i)
    least = {k: min([x for x in v if x is not None], default=None) for k, v in least.items()}
    return sorted([(i, f"{p:016x}", least[top(p)]) for i, p in prints], key=repr)


def test_fingerprints():
    r = random.Random(3)
    texts = ["", "  \n", "one", "One TWO", "a b c d", "a  b\tc\x0bd \n e É", "ÀÉ ß x y z w", *[" ".join(r.choice("ab cd é e\n") for _ in range(r.randint(1, 300))) for _ in range(200)], "word " * 70_000]
    assert [int(x) for x in simhash.fingerprints_of(pa.array(texts))] == [brute_print(t) for t in texts]
    assert [int(x) for x in simhash.fingerprints_of(pa.array(texts).slice(3, 9))] == [brute_print(t) for t in texts[3:12]]
    assert len(simhash.fingerprints_of(pa.array([], pa.string()))) == 0


def test_near_duplicates(documents, rows):
    want = brute_components([(r[0], brute_print(r[1])) for r in rows])
    assert collected(simhash.near_duplicates(documents), "doc_id", "fingerprint", "component_id") == want
    assert len({c for _, _, c in want}) < len(want) - 3  # some are linked


def family_prints(n, seed):
    """Fingerprints in families: random ones, and others some bits away from one before."""
    r = random.Random(seed)
    out = [0, 15, (1 << 64) - 1]
    while len(out) < n:
        x = r.getrandbits(64) if r.random() < 0.3 else r.choice(out)
        for _ in range(r.randint(0, 7)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("bucket,tree,shard,most,passes", [(256, 1 << 14, 1 << 16, 48 << 20, 16), (256, 1 << 14, 1 << 16, 48 << 20, 0), (1, 3, 40, 3000, 1000), (1, 3, 40, 3000, 2), (256, 2, 7, 100, 1000)])
def test_links(spark, monkeypatch, bucket, tree, shard, most, passes):
    """Trees cut in parts, many shards, several broadcasts, more trees than are broadcast and smaller buckets give the links of all pairs."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", most)
    monkeypatch.setattr(simhash, "PASSES", passes)
    n = 60 if most == 100 else 400
    prints = family_prints(n, tree)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in sorted(set(signed))], "fp long").repartition(3))
    value = lambda x: x % (1 << 64)
    pairs = [(value(x["a"]), value(x["b"])) for x in found.collect()]
    want = brute_components(list(enumerate(prints)))
    named = {int(p, 16): c for _, p, c in want}
    assert all(named[a] == named[b] for a, b in pairs)
    root = {p: p for p in prints}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        root[top(a)] = top(b)
    assert len({top(p) for p in prints}) == len({c for _, _, c in want})
    assert len(pairs) <= n * len(simhash.masks(n)) * (1 if tree > 100 else 12)


def test_search_follows_edges_within_the_radius_only():
    r = np.random.default_rng(5)
    values = np.unique(r.integers(0, 1 << 63, 3000).astype(np.uint64))
    forest = simhash.Forest.grown(values, np.array([0]), np.zeros(len(values), dtype=np.int64))
    assert all(int(values[i] ^ values[p]).bit_count() == e for i, (p, e) in enumerate(zip(forest.parent, forest.edge, strict=True)) if p >= 0)
    assert len({(p, e) for p, e in zip(forest.parent.tolist(), forest.edge.tolist(), strict=True)}) == len(values)
    q, node = forest.near(values, np.zeros(len(values), dtype=np.int64), 24)
    want = {(i, j) for i in range(0, 3000, 7) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 24).tolist()}
    assert {(i, j) for i, j in zip(q.tolist(), node.tolist(), strict=True) if i % 7 == 0} == want


def test_more_fingerprints_make_smaller_buckets():
    for n, runs in ((10, 1), (1 << 19, 1), (1 << 24, 2), (1 << 32, 3), (1 << 40, 4)):
        chosen = simhash.masks(n)
        assert len({m.bit_count() for m in chosen}) <= 4 and min(m.bit_count() for m in chosen) >= 64 * runs // (4 + runs) - 2
        r = random.Random(n)
        for _ in range(50):  # whichever four bits differ, some choice of runs has none of them
            x = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not m & x for m in chosen)
