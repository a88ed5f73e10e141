"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A position is ``STRIDE`` bytes, one byte as it stands; a text is read whole, in windows of ``WINDOW`` positions that start with fresh states.
Both directions of a window see their byte embeddings and a gated recurrent unit; a softmax over both states labels
every position, and a document's probabilities are the means over all of its positions. Training is backpropagation
through time with Adam, on at most ``SAMPLE`` labelled documents of each language (chosen by a hash of doc_id) and
``EXCERPT`` characters of each.

Nulls: a null text is ``und`` with score 0, as is one without letters; a null lang is never learned from; a null doc_id
is hashed as the empty string. With no labelled text, all is ``und``. Repeated rows are labelled one by one; an empty
table gives no rows. Only doc_id, text and (to learn) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import chunks, only, text_array

STRIDE, WINDOW, HIDDEN = 1, 256, 8
#: The bound of the training sample: documents per language, characters of each.
SAMPLE, EXCERPT = 600, 1000
#: Languages up to which their counts are broadcast (the network has an output for each); beyond, they are joined by shuffling.
BROADCAST_LANGS = 10_000
STEPS, BATCH, RATE, TRAIN_POSITIONS = 260, 192, 0.02, 96


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights of both directions: ``embed`` (STRIDE, 256, 6 H), ``gates`` and ``fresh`` per direction, ``out`` and ``bias``."""

    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, langs: list[str], seed: int = 10) -> Network:
        r = np.random.default_rng(seed)
        h = HIDDEN
        w = {"embed": r.normal(0, 0.3, (STRIDE, 256, 6 * h)), "base": np.zeros(6 * h), "gates": r.normal(0, 0.3, (2, h, 2 * h)), "fresh": r.normal(0, 0.3, (2, h, h)), "out": r.normal(0, 0.3, (2 * h, len(langs))), "bias": np.zeros(len(langs))}
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, x: np.ndarray, keep: bool = False, inside: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """Hidden states (positions, texts, 2 H) of bytes (positions, texts, STRIDE); with ``keep``, what backpropagation needs.

        ``inside`` (positions, texts) says which positions are a text's own: the backward direction starts fresh at its last one.
        """
        t, b, _ = x.shape
        whole = inside.all(axis=1) if inside is not None else np.ones(t, dtype=bool)
        h3, w, tape = 3 * HIDDEN, self.weights, []
        out = np.empty((t, b, 2 * HIDDEN), dtype=np.float32)
        for d in (0, 1):
            h = np.zeros((b, HIDDEN), dtype=np.float32)
            embed, base = np.ascontiguousarray(w["embed"][:, :, d * h3 : (d + 1) * h3]), w["base"][d * h3 : (d + 1) * h3]
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                a = embed[0].take(x[i, :, 0], axis=0)
                for s in range(1, STRIDE):
                    a += embed[s].take(x[i, :, s], axis=0)
                a += base
                g = _sigmoid(a[:, : 2 * HIDDEN] + h @ w["gates"][d])
                z, r = g[:, :HIDDEN], g[:, HIDDEN:]
                n = np.tanh(a[:, 2 * HIDDEN :] + (r * h) @ w["fresh"][d])
                if keep:
                    tape.append((d, i, h, z, r, n))
                h = n + z * (h - n)
                if d == 1 and not whole[i]:
                    h *= inside[i][:, None]
                out[i, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        return out, tape

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.weights["out"] + self.weights["bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        t, b, _ = x.shape
        states, tape = self.states(x, keep=True)
        p = self.probabilities(states)
        loss = float(-np.log(p[:, np.arange(b), y] + 1e-9).mean())
        delta = p
        delta[:, np.arange(b), y] -= 1
        delta /= t * b
        w, h3 = self.weights, 3 * HIDDEN
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"] = np.einsum("tbh,tbc->hc", states, delta)
        g["bias"] = delta.sum(axis=(0, 1))
        to_states = delta @ w["out"].T
        back = [np.zeros((b, HIDDEN), dtype=np.float32) for _ in (0, 1)]
        for d, i, h, z, r, n in reversed(tape):
            dh = to_states[i, :, d * HIDDEN : (d + 1) * HIDDEN] + back[d]
            dn, dz = dh * (1 - z), dh * (h - n)
            da_n = dn * (1 - n * n)
            drh = da_n @ w["fresh"][d].T
            da = np.concatenate([dz * z * (1 - z), drh * h * r * (1 - r), da_n], axis=1)
            g["gates"][d] += h.T @ da[:, : 2 * HIDDEN]
            g["fresh"][d] += (r * h).T @ da_n
            back[d] = dh * z + drh * r + da[:, : 2 * HIDDEN] @ w["gates"][d].T
            g["base"][d * h3 : (d + 1) * h3] += da.sum(axis=0)
            for s in range(STRIDE):
                np.add.at(g["embed"][s][:, d * h3 : (d + 1) * h3], x[i, :, s], da)
        return loss, g


def train(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 10) -> Network | None:
    """Fit on (language, bytes); languages weigh alike."""
    by: dict[str, list[np.ndarray]] = {}
    for lang, raw in samples:
        if len(raw) >= STRIDE:
            by.setdefault(lang, []).append(np.frombuffer(raw, dtype=np.uint8))
    if not by:
        return None
    net, r, need = Network.new(sorted(by), seed), np.random.default_rng(seed), TRAIN_POSITIONS * STRIDE
    first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in (0, 1))
    for step in range(1, steps + 1):
        y = r.integers(len(net.langs), size=BATCH)
        x = np.zeros((BATCH, need), dtype=np.uint8)
        for j, c in enumerate(y.tolist()):
            own = by[net.langs[c]]
            raw = own[r.integers(len(own))]
            at = r.integers(max(1, len(raw) - need + 1))
            cut = raw[at : at + need]
            x[j, : len(cut)] = cut
        _, g = net.gradients(np.ascontiguousarray(x.reshape(BATCH, TRAIN_POSITIONS, STRIDE).transpose(1, 0, 2)), y)
        scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((v**2).sum() for v in g.values())))))
        rate = RATE * (1 - 0.9 * step / steps)
        for k, v in g.items():
            v *= scale
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label(net: Network, texts: pa.Array) -> np.ndarray:
    """Mean probabilities (texts, languages) over all positions of each text; empty texts have zeros."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    sizes = np.diff(offsets)
    each = STRIDE * WINDOW
    windows = -(-sizes // each)
    doc = np.repeat(np.arange(len(sizes)), windows)
    begin = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)) * each
    length = np.minimum(offsets[1:][doc] - begin, each)
    order = np.argsort(-length, kind="stable")
    sums = np.zeros((len(sizes), len(net.langs)))
    for s in range(0, len(order), 2048):
        at = order[s : s + 2048]
        most = -(-int(length[at[0]]) // STRIDE)
        index = begin[at][:, None] + np.arange(most * STRIDE)
        inside = np.arange(most * STRIDE) < length[at][:, None]
        x = np.where(inside, data[np.minimum(index, len(data) - 1)], 0)
        real = np.ascontiguousarray(inside[:, ::STRIDE].T)
        p = net.probabilities(net.states(np.ascontiguousarray(x.reshape(len(at), most, STRIDE).transpose(1, 0, 2)), inside=real)[0])
        np.add.at(sums, doc[at], np.einsum("tbc,tb->bc", p, real.astype(np.float32)))
    return sums / np.maximum(-(-sizes // STRIDE), 1)[:, None]


def training_sample(documents: DataFrame, per_lang: int = SAMPLE, excerpt: int = EXCERPT) -> list[tuple[str, bytes]]:
    """At most ``per_lang`` excerpts of each language outside the held-out fold, spread over all documents by hash."""
    rows = only(documents, doc_id="doc_id", text="text", lang="lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    luck = F.xxhash64("doc_id", F.lit(10))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGS else counts
    few = rows.select("doc_id", "lang", luck.alias("luck")).join(counts, "lang").filter(F.col("luck") / F.lit(2.0**63) < F.lit(4.0 * per_lang) / F.col("n") - 1.0)
    top = Window.partitionBy("lang").orderBy("luck", "doc_id")
    few = few.withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= per_lang).select("doc_id", "lang").distinct()  # per_lang of each language
    room = F.length("text") - F.lit(excerpt)
    start = F.when(room > 0, F.pmod(F.xxhash64("doc_id", F.lit(11)), room) + 1).otherwise(F.lit(1)).cast("int")
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(few), rows["doc_id"].eqNullSafe(few["doc_id"]) & (rows["lang"] == few["lang"]), "left_semi")
    got = texts.select("lang", luck.alias("luck"), F.substring("text", start, F.lit(excerpt)).alias("text")).collect()
    return [(r["lang"], r["text"].encode()) for r in sorted(got, key=lambda r: (r["lang"], r["luck"], r["text"]))]


def label_rows(documents: DataFrame, net: Network | None) -> DataFrame:
    """row (a struct of all columns), lang_pred, score: every document with its label beside it."""
    names = {c.lower(): c for c in documents.columns}
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{names['text']}`").cast("string").alias("text"))
    return _labelled(rows.select("row", "text"), net)


def predict(documents: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text."""
    rows = only(documents, doc_id="doc_id", text="text").select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out")).alias("row"), "text")
    return _labelled(rows, net).select("row.doc_id", "row.held_out", "lang_pred", "score")


def _labelled(documents: DataFrame, net: Network | None) -> DataFrame:
    """row, lang_pred, score of row, text."""
    model = documents.sparkSession.sparkContext.broadcast(net)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=2 << 20):
            texts = text_array(b)
            p = label(model.value, texts) if model.value else np.zeros((len(texts), 1))
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False) & (model.value is not None)
            best = p.argmax(axis=1)
            langs = model.value.langs if model.value else ["und"]
            langs = [langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            score = np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    schema = T.StructType([documents.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return documents.mapInArrow(labelled, schema)


def identify(documents: DataFrame) -> DataFrame:
    """Train on the documents' own labels, then label them all."""
    return predict(documents, train(training_sample(documents)))
