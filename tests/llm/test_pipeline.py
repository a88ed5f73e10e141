"""The pipeline's stages against brute force, each on its own input."""

import collections
import unicodedata
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tests.llm.test_operators import LOWER, WORD, brute_lines, brute_targets
from tokenizers import Tokenizer

from tidepool.llm import lang_id
from tidepool.llm.queries import tokenizer


def shown(rows):
    return sorted(map(repr, rows))


def languages(docs, rows):
    """The rows with a letter, but for those of mostly other characters that no language has half of."""
    net = lang_id.train(lang_id.training_sample(docs))
    out = []
    for r in rows:
        text = r[1] or ""
        letters = sum(unicodedata.category(c)[0] in "LM" for c in text)
        others = sum(unicodedata.category(c)[0] not in "LM" and not c.isspace() for c in text)
        sure = lang_id.label(net, pa.array([text])).max() >= 0.5
        if any(unicodedata.category(c)[0] == "L" for c in text) and (letters >= others or sure):
            out.append(r)
    return out


def representatives(rows):
    """Distinct rows, of each component by five-word shingles one: the smallest id, null before all."""
    rows = list({(r[0], r[1]): r for r in rows}.values())
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)) if w else frozenset())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for r, g in zip(rows, group, strict=True):
        best[g] = min(best.get(g, r), r, key=lambda x: (x[0] is not None, x[0] or 0))
    return list(best.values())


def test_stages(spark, documents):
    docs = documents.withColumn("line_dedup", F.lit("x")).drop("line_dedup").withColumn("cuts", F.lit(1)).withColumn("__gone", F.lit(2))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "").cache()
        rows = [tuple(r) for r in before.select("doc_id", "text", "source").collect()]
        if name == "packing":
            t, want = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), []
            for r in rows:
                ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
                want += [(r[0], k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
            assert shown(want) == shown(tuple(r) for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
            continue
        assert docs.columns == columns and docs.filter("cuts <> 1 or __gone <> 2").count() == 0
        got = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        if name == "language_id":
            assert shown(got) == shown(languages(before, rows)) and 0 < len(got) < len(rows)
        if name == "line_dedup":
            want = brute_lines(rows)
            left = [(i, want[i, t][0], s) for i, t, s in rows if want[i, t][2] == 0 or want[i, t][0].strip()]
            assert shown(left) == shown(got)
        if name == "near_duplicates":
            assert shown(got) == shown(representatives(rows)) and len(got) < len(rows)
        if name == "source_mixing":
            size = lambda r: len(WORD.findall(r[1] or ""))
            copies, taken, sizes = collections.Counter(got), collections.Counter(), collections.Counter()
            for r in rows:
                sizes[r[2]] += size(r)
            for r, n in copies.items():
                assert r in rows and n <= 2
                taken[r[2]] += n * size(r)
            for k, target in brute_targets(sizes).items():
                assert abs(taken[k] - target) <= max(size(r) for r in rows if r[2] == k)


def test_stages_of_nothing(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        assert docs.count() == 0


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_language_stage_keeps_clean_documents(spark, data, documents):
    d = spark.read.parquet(f"{data}/documents.parquet")
    mixed = " ".join(r["text"][:400] for r in d.filter("length(text) > 400 and lang is not null").groupBy("lang").agg(F.min("text").alias("text")).collect())
    odd = [(-1, mixed), (-2, "Die tz."), (-3, "A.\nAll rights reserved."), (-4, "De."), (-5, "12 % !!"), (-6, None)]
    clean = d.filter(F.col("text").rlike(r"\p{L}"))
    rows = d.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    kept = corpus_pipeline.identify_languages(spark, rows, "")
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in clean.select("doc_id").collect()} | {-1, -2, -3, -4}
    none = corpus_pipeline.identify_languages(spark, documents.withColumn("lang", F.lit(None).cast("string")), "")
    assert none.count() == documents.filter(F.col("text").rlike(r"\p{L}")).count() > 60
