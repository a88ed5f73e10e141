"""Logs in JSON lines as Spark's text source reads them: cut in byte ranges at line ends, on any file system.

A log is a file, or the files of a folder in the order of their names (a log that is rotated). Where a range begins in its log is
only known once the ranges before it are counted: every range counts its lines and its messages, the counts, a row a range,
are summed up, and rows are numbered within their range. The events are taken apart as VARIANT values in the JVM; Python looks
into results of tools only, which may nest without bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.images import IMAGE_TYPES, TEXT_TYPES, nested_images



def log_lines(spark: SparkSession, path: str | list[str], rotated: bool = False) -> DataFrame:
    """log, file, range (its first byte), seq (rising within a range) and value of each line, blank ones too.

    ``rotated``: the files of a folder are one log. A line ends at a line feed; a carriage return before it is left.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("seq"))
    return rows.select((F.regexp_extract("file", "^(.*)/[^/]*$", 1) if rotated else F.col("file")).alias("log"), "file", "range", "seq", "value")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _string(v: Column, path: str) -> Column:
    """A string at a path; null for other values."""
    return F.when(_is(F.try_variant_get(v, path, "variant"), "STRING"), F.try_variant_get(v, path, "string"))


@F.pandas_udf(T.IntegerType())
def images_within(value: pd.Series) -> pd.Series:
    """How many images a tool's result, as JSON, holds at any depth."""
    return value.map(lambda s: 0 if s is None else sum(1 for _ in nested_images(json.loads(s)))).astype("int32")


class Nested:
    """A table function: nth, image (JSON) of the images in a tool's result, at any depth, in order."""

    def eval(self, value: str) -> Iterator[tuple[int, str]]:
        for i, image in enumerate(nested_images(json.loads(value)) if value is not None else ()):
            yield i, json.dumps(image, ensure_ascii=False, sort_keys=True)


def image_rows(rows: DataFrame, value: str) -> DataFrame:
    """Each row once for each image in its column of JSON, with nth and image; no row where there's none."""
    function = F.udtf(Nested, returnType="nth int, image string")
    return rows.lateralJoin(function(F.col(value).outer()))


def events(lines: DataFrame, client: str) -> DataFrame:
    """lines that aren't blank, with problem, role, images, timestamp, text and inner (JSON of results that hold other images).

    ``role`` is null where an event isn't a message to show; ``problem`` says why a line can't be read.
    """
    v = F.col("event")
    rows = lines.filter(F.trim(F.regexp_replace("value", r"[\t\r\x0b\f]", "")) != "").withColumn("event", F.try_parse_json("value"))
    problem = F.when(v.isNull(), F.lit("not whole JSON")).when(~_is(v, "OBJECT"), F.lit("not a JSON object"))
    kind = _string(v, "$.type")
    item = F.when(kind == "response_item", F.try_variant_get(v, "$.payload", "variant")) if client == "codex" else F.when(kind.isin("user", "assistant"), F.try_variant_get(v, "$.message", "variant"))
    rows = rows.select(*lines.columns, problem.alias("problem"), kind.alias("kind"), _string(v, "$.timestamp").alias("timestamp"), F.when(_is(item, "OBJECT"), item).alias("item"))
    i = F.col("item")
    said = _string(i, "$.type") == "message" if client == "codex" else F.lit(True)
    called = F.coalesce(~said, F.lit(True)) & F.contains(F.coalesce(F.try_variant_get(i, "$.type", "string"), F.lit("")), F.lit("call"))
    given = F.coalesce(_string(i, "$.role"), F.when(F.try_variant_get(i, "$.role", "variant").isNull(), F.col("kind")))
    role = F.when(said & given.isin("user", "assistant") & ~F.coalesce(_string(i, "$.channel") == "analysis", F.lit(False)), given)
    role = F.when(i.isNotNull() & called, F.lit("assistant")).otherwise(role) if client == "codex" else role
    content = F.try_variant_get(i, "$.content", "variant")
    parts = F.when(_is(content, "ARRAY"), F.try_variant_get(content, "$", "array<variant>"))
    parts = F.transform(F.coalesce(parts, F.array().cast("array<variant>")), lambda p: F.struct(_string(p, "$.type").alias("type"), _string(p, "$.text").alias("text"), F.to_json(F.try_variant_get(p, "$.content", "variant")).alias("inner")))
    parts = F.when(_is(content, "STRING"), F.array(F.struct(F.lit(TEXT_TYPES[0]).alias("type"), _string(content, "$").alias("text"), F.lit(None).cast("string").alias("inner")))).otherwise(parts)
    rows = rows.select(*lines.columns, "problem", "timestamp", role.alias("role"), F.when(F.lit(client == "codex") & called, F.array()).otherwise(parts).alias("parts"), F.when(called, F.to_json(F.try_variant_get(i, "$.output", "variant"))).alias("output"))
    texts = F.filter("parts", lambda p: p["type"].isin(*TEXT_TYPES) & p["text"].isNotNull())
    inner = F.filter(F.concat(F.transform(F.filter("parts", lambda p: p["type"] == "tool_result"), lambda p: p["inner"]), F.array("output") if client == "codex" else F.array().cast("array<string>")), lambda x: x.isNotNull())
    whole = F.when(F.size(inner) > 0, F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")))
    shown = F.size(F.filter("parts", lambda p: p["type"].isin(*IMAGE_TYPES)))
    return rows.select(*lines.columns, "problem", "role", shown.alias("images"), "timestamp", F.array_join(F.transform(texts, lambda p: p["text"]), "\n").alias("text"), whole.alias("inner"))


def log_messages(spark: SparkSession, path: str | list[str], client: str, rotated: bool = False) -> DataFrame:
    """log, number, line, role, images, timestamp, text of each readable message: the numbers of one stream over each log.

    A line that can't be read fails the query, as a log is only as good as its numbers.
    """
    rows = events(log_lines(spark, path, rotated), client)
    broken = F.concat(F.lit("a line isn't "), F.regexp_replace("problem", "^not ", ""), F.lit("; it may still be written: "), F.col("file"))
    rows = rows.withColumn("role", F.when(F.col("problem").isNotNull(), F.raise_error(broken)).otherwise(F.col("role")))
    rows = rows.withColumn("images", F.when(F.col("role").isNotNull(), F.col("images") + F.when(F.col("inner").isNotNull(), images_within("inner")).otherwise(0)).otherwise(0))
    shown = F.col("role").isNotNull() & ((F.col("text") != "") | (F.col("images") > 0))

    all_lines = log_lines(spark, path, rotated).groupBy("log", "file", "range").agg(F.count("*").alias("lines"), F.min("seq").alias("first"))
    said = rows.filter(shown).groupBy("log", "file", "range").agg(F.count("*").alias("messages"))
    ranges = all_lines.join(said, ["log", "file", "range"], "left")
    before = Window.partitionBy("log").orderBy(F.length("file"), "file", "range").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ranges = ranges.select("log", "file", "range", "first", total("lines").alias("lines"), total("messages").alias("messages"))

    own = Window.partitionBy("log", "file", "range").orderBy("seq")
    nth = rows.filter(shown).withColumn("nth", F.row_number().over(own))
    placed = nth.join(ranges, ["log", "file", "range"])
    return placed.select("log", (F.col("messages") + F.col("nth")).alias("number"), (F.col("lines") + F.col("seq") - F.col("first") + 1).alias("line"), "role", "images", "timestamp", "text")
