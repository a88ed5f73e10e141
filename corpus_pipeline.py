"""A corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing; each stage is one operator.

Every stage is written as Parquet and read again as the next one's documents. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import jaccard_join, lang_id, line_dedup, mixing, packing
from tidepool.llm.common import staged, unstage
from tidepool.llm.queries import tokenizer

#: A document of mostly other characters than letters stays if some language takes at least this share of its positions.
LEAST_SHARE = 0.5


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of mostly other characters in which no language is sure enough.

    A low score alone tells nothing: texts in several languages and very short ones have it too. Where no row has a
    language to learn from, all documents with a letter stay.
    """
    net = lang_id.train(lang_id.training_sample(docs))
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    labelled = lang_id.label_rows(docs, net)
    others, letters = (F.length(F.regexp_replace("row.text", x, "")) for x in (r"[\p{L}\p{M}\s]+", r"[^\p{L}\p{M}]+"))
    return labelled.filter((F.col("lang_pred") != "und") & ((F.col("score") >= LEAST_SHARE) | (letters >= others))).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; a document that has nothing else goes with them. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("line_dedup.n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", "")) == "")
    out = out.filter(~F.coalesce(emptied, F.lit(False)))
    changed = F.when(F.col("line_dedup.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).drop("line_dedup") if "n_chars" in out.columns else out.drop("line_dedup")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it."""
    return mixing.repeat_by_copies(docs, mixing.mix_sources(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages train a network, hash lines and round at random: SQL has no such rows; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, before = staged(docs), written
            written = docs
            if before is not None:
                unstage(before)
    return docs
