"""Keep an archive of conversations up to date: every readable message as a numbered Markdown card.

    python -m jobs.session_archive SOURCE TARGET CHECKPOINT [--config FILE]

SOURCE is a folder of Parquet files of turns (conv_id, turn, role, text) to which files are added. A run takes the files that
no run has taken yet, as a file stream with ``availableNow`` whose checkpoint is CHECKPOINT, writes what is new and ends:

* TARGET/messages, by batch and shelf (a hash of conv_id): conv_id, turn, role, number, card. Numbers go on from the batches before.
* TARGET/sessions, by batch: conv_id, messages, last_turn of each conversation that the batch brings turns of.
* TARGET/aside, by batch: rows that have no place, with the reason: no conv_id or turn, or a turn that isn't behind those
  already archived (a file that was delivered again, a row that came late). They change no number.

A batch only ever writes its own folders, from its own rows and the sessions of earlier batches. One that is run again after
a failure writes the same rows in the same place.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from jobs.common import command, missing, settings
from tidepool.functions import text as X
from tidepool.operators import messages
from tidepool.sources.files import scratch

NAME = "session_archive"
TURNS = "conv_id long, turn long, role string, text string"
SESSIONS = "conv_id long, messages long, last_turn long, batch long"
MESSAGES = "conv_id long, turn long, role string, number long, card string, batch long, shelf int"
log = logging.getLogger(f"jobs.{NAME}")


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if not missing(e):
            raise
        return spark.createDataFrame([], schema)


def archive(rows: DataFrame, batch: int, target: str, client: str, shelves: int, span: int, collapse_context: bool) -> dict:
    """Write one batch of turns; how many rows were read, and written where."""
    spark = rows.sparkSession
    rows = rows.select("conv_id", "turn", "role", "text").persist()
    try:
        placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
        earlier = table(spark, f"{target}/sessions", SESSIONS).filter(F.col("batch") < batch)
        earlier = earlier.join(rows.select("conv_id").distinct(), "conv_id", "left_semi")
        known = earlier.groupBy("conv_id").agg(F.max_by(F.struct("messages", "last_turn"), "batch").alias("s")).select("conv_id", "s.*")
        marked = rows.join(known.select("conv_id", "last_turn"), "conv_id", "left")
        new = placed & (F.col("last_turn").isNull() | (F.col("turn") > F.col("last_turn")))
        fresh = marked.filter(new).drop("last_turn")

        numbered = messages.numbered(fresh, before=known, span=span)
        card = X.message_card(F.col("role"), F.col("number"), F.lit(""), F.col("text"), client, collapse_context)
        shelf = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shelves)).cast("int")
        cards = numbered.select("conv_id", "turn", "role", "number", card.alias("card"), shelf.alias("shelf")).hint("rebalance", "shelf")
        cards.sortWithinPartitions("shelf", "conv_id", "number").write.mode("overwrite").partitionBy("shelf").parquet(f"{target}/messages/batch={batch}")

        reason = F.when(~placed, F.lit("no conv_id or turn")).otherwise(F.lit("not behind the turns before"))
        marked.filter(~new).select("conv_id", "turn", "role", "text", reason.alias("reason")).write.mode("overwrite").parquet(f"{target}/aside/batch={batch}")

        counted = fresh.groupBy("conv_id").agg(F.count_if(messages.is_readable()).alias("n"), F.max("turn").alias("last_turn"))
        state = counted.join(known.select("conv_id", "messages"), "conv_id", "left")
        state = state.select("conv_id", (F.coalesce("messages", F.lit(0)) + F.col("n")).alias("messages"), "last_turn")
        state.write.mode("overwrite").parquet(f"{target}/sessions/batch={batch}")

        written = {name: table(spark, f"{target}/{name}/batch={batch}", "conv_id long").count() for name in ("messages", "sessions", "aside")}
        report = {"batch": batch, "turns_read": rows.count(), **written}
    finally:
        rows.unpersist()
    log.info("batch %s: read %s turns, wrote %s to %s", batch, report["turns_read"], written, target)
    return report


def run(spark: SparkSession, source: str, target: str, checkpoint: str, client: str, shelves: int, span: int, collapse_context: bool, files_per_batch: int) -> dict:
    """Archive the files of ``source`` that are new to ``checkpoint``, the oldest first; the counts of this run's batches, summed up."""
    done: list[dict] = []

    def batch(rows: DataFrame, number: int) -> None:
        done.append(archive(rows, number, target, client, shelves, span, collapse_context))

    # a pattern of one name stands for a folder as for a single file, which a stream doesn't take by its plain path;
    # files stay valid whatever their age, as a copy may keep an old time of change
    folder, _, name = source.rstrip("/").rpartition("/")
    turns = spark.readStream.schema(TURNS).option("maxFileAge", "36500d").option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{{{name}}}")
    stream = turns.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    report = {"batches": len(done)} | {k: sum(d[k] for d in done) for k in ("turns_read", "messages", "sessions", "aside")}
    log.info("took %s from %s", report, source)
    return report


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over all conversations, run twice with one checkpoint; conv_id, turn, number, role and card of the whole archive."""
    at = scratch(spark)
    for _ in range(2):
        run(spark, f"{sf_dir}/conversations.parquet", f"{at}/archive", f"{at}/checkpoint", **settings(NAME))
    return table(spark, f"{at}/archive/messages", MESSAGES).select("conv_id", "turn", "number", "role", "card")


SQL = """
WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS number FROM conversations
  WHERE role IN ('user', 'assistant') AND text <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id, turn, number, role, '> [!' || CASE role WHEN 'user' THEN 'question] 你' ELSE 'success] Claude' END || ' · ' || printf('%02d', number) || chr(10) || '>' || chr(10)
  || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || '^message-' || printf('%02d', number) || chr(10) || chr(10) AS card FROM m
"""

if __name__ == "__main__":
    command(NAME, __doc__, {"source": "folder of Parquet files of turns", "target": "folder of the archive", "checkpoint": "folder of the stream's checkpoint"}, run)
