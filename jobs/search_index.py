"""Build the search index of a corpus of documents: postings by term, for keyword search that reads no text.

    python -m jobs.search_index DOCUMENTS TARGET [--config FILE]

Reads a table of documents (doc_id, text, lang, source) and writes TARGET/postings, partitioned by a bucket of the term,
and TARGET/documents, the documents that can be found, partitioned by language. Every run replaces both; the same documents
give the same rows. A document without a doc_id can't be named by a posting: it is counted in the log and left out.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, settings
from tidepool.functions import text as X
from tidepool.operators import postings
from tidepool.queries import SQL_NOTES, SQL_PASSAGE, note_rows, passages, sql_tokens
from tidepool.sources.files import scratch

NAME = "search_index"
log = logging.getLogger(f"jobs.{NAME}")


def run(spark: SparkSession, documents: str, target: str, span: int) -> dict:
    """Build the index of the table at ``documents`` into the folder ``target``; what was read and written, as counts."""
    notes = note_rows(spark.read.parquet(documents))
    found = notes.filter("doc_id is not null")
    postings.write(passages(found), f"{target}/postings", span=span, text="passage")
    listed = found.select("doc_id", "path", F.coalesce("lang", F.lit("")).alias("lang"), X.fingerprint(F.col("text")).alias("fingerprint"))
    listed.write.mode("overwrite").partitionBy("lang").parquet(f"{target}/documents")
    table = postings.read(spark, f"{target}/postings")
    counts = table.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.when(F.col("term") != postings.EVERY, F.col("n"))), F.lit(0)).alias("postings"), F.count_distinct("term").alias("terms")).first()
    read, written = notes.count(), found.count()
    report = {"documents_read": read, "documents_indexed": written, "without_id": read - written, "blocks": counts["blocks"], "postings": counts["postings"], "terms": max(0, counts["terms"] - 1)}
    log.info("read %s from %s, wrote %s to %s", read, documents, report, target)
    return report


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over all documents, run twice into one folder; term, doc_id, tf, n_tokens and the document's path, read back."""
    target = scratch(spark)
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", target, **settings(NAME))
    rows = postings.expanded(postings.read(spark, f"{target}/postings"))
    listed = spark.read.schema("doc_id long, path string, fingerprint string, lang string").parquet(f"{target}/documents")
    # by hash: the postings, of which there are far more, needn't be sorted
    return rows.join(listed.hint("shuffle_hash"), rows["doc"] == listed["doc_id"]).select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.col("len").cast("long").alias("n_tokens"), "path")


SQL = f"""
WITH t AS (SELECT doc_id, path, {sql_tokens(SQL_PASSAGE)} AS tok FROM ({SQL_NOTES}) WHERE doc_id IS NOT NULL)
SELECT term, doc_id, count(*) AS tf, any_value(n) AS n_tokens, any_value(path) AS path FROM (SELECT doc_id, path, len(tok)::BIGINT AS n, unnest(tok) AS term FROM t) GROUP BY term, doc_id
"""

if __name__ == "__main__":
    command(NAME, __doc__, {"documents": "Parquet table of documents", "target": "folder that the index is written to"}, run)
