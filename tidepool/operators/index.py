"""The vector index: which keys are fresh, missing or new, and Parquet tables that a refresh adds to."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.ranking import normalised, valid_vector

VECTORS = "key string, vector array<double>"
NOTES = "path string, fingerprint string"
GONE = "key string"
#: Runs that a version is made of before they are written together as one.
MOST_RUNS = 12


def passages(chunks: DataFrame, *more: Column) -> DataFrame:
    """key, passage and further aggregates: each passage once."""
    return chunks.groupBy("key").agg(F.first("passage").alias("passage"), *more)


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """key, passage: passages without a vector, each once."""
    return passages(chunks).join(vectors.select("key"), "key", "left_anti")


def reused(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vectors that current passages still need."""
    return vectors.join(chunks.select("key"), "key", "left_semi")


def manifest_changes(notes: DataFrame, old: DataFrame) -> DataFrame:
    """One row: new_notes, changed_notes, deleted_notes between two manifests (path, fingerprint)."""
    both = notes.select("path", F.col("fingerprint").alias("now")).join(old.select("path", F.col("fingerprint").alias("was")), "path", "full_outer")
    return both.agg(
        F.count_if(F.col("was").isNull()).alias("new_notes"),
        F.count_if(F.col("now") != F.col("was")).alias("changed_notes"),
        F.count_if(F.col("now").isNull()).alias("deleted_notes"),
    )


def coverage(notes: DataFrame, chunks: DataFrame, vectors: DataFrame, old: DataFrame) -> DataFrame:
    """One row: notes, chunks (distinct keys), fresh_chunks, missing_chunks, and the manifest's changes."""
    keys = chunks.select("key").distinct().join(vectors.select("key", F.lit(1).alias("hit")).distinct(), "key", "left")
    counts = keys.agg(F.count("*").alias("chunks"), F.count("hit").alias("fresh_chunks"), F.count_if(F.col("hit").isNull()).alias("missing_chunks"))
    return notes.agg(F.count("*").alias("notes")).crossJoin(counts).crossJoin(manifest_changes(notes, old))  # one row each


class VectorIndex:
    """Tables per embedding profile, read as the sum of a few runs.

    A refresh writes one run, with what is different only: vectors of passages that had none (``vectors``), keys whose passages
    are gone (``gone``), notes that are new, changed or, with a null fingerprint, gone (``notes``). A version is a numbered file
    that names its runs in order. It appears complete and never replaces another, so of two writers one fails, and a
    reader, which takes the highest number, finds the version before or the one after. When the runs are many, or half of what
    they hold is gone, they are written anew as one. ``root`` may be any path that Spark writes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _at(self, profile: str, *more: str) -> str:
        return "/".join([self.root, f"profile={profile}", *more])

    def _listed(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _drop(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def versions(self, profile: str) -> list[int]:
        """The numbers of the versions that are there, in order."""
        return [int(x.removesuffix(".json")) for x in self._listed(self._at(profile, "versions")) if x.endswith(".json")]

    def version(self, profile: str, number: int | None = None) -> dict | None:
        """What a version, else the last one, is made of; None without an index."""
        numbers = self.versions(profile) if number is None else [number]
        if not numbers:
            return None
        return json.loads(self.spark.read.text(self._at(profile, "versions", f"{numbers[-1]:012}.json"), wholetext=True).first()[0])

    def _runs(self, profile: str, runs: list[str], table: str, schema: str) -> DataFrame:
        """A table of all runs, with ``run``, their place in the version."""
        parts = [self.spark.read.schema(schema).parquet(self._at(profile, "runs", r, table)).withColumn("run", F.lit(i)) for i, r in enumerate(runs)]
        return functools.reduce(DataFrame.unionByName, parts)

    def _held(self, profile: str, runs: list[str]) -> tuple[DataFrame, DataFrame]:
        """The vectors and notes of a version: those that no later run takes back or replaces."""
        vectors, notes = self._runs(profile, runs, "vectors", VECTORS), self._runs(profile, runs, "notes", NOTES)
        if len(runs) > 1:
            gone = self._runs(profile, runs, "gone", GONE).groupBy("key").agg(F.max("run").alias("gone"))
            vectors = vectors.join(gone, (vectors["key"] == gone["key"]) & (gone["gone"] > vectors["run"]), "left_anti")
            notes = notes.groupBy("path").agg(F.max_by("fingerprint", "run").alias("fingerprint"))
        return vectors.select("key", "vector"), notes.filter("fingerprint is not null").select("path", "fingerprint")

    def read(self, profile: str) -> tuple[DataFrame, DataFrame, dict | None]:
        """vectors, notes, info; empty tables without an index. Vectors are validated again."""
        info = self.version(profile)
        if info is None:
            return self.spark.createDataFrame([], VECTORS), self.spark.createDataFrame([], NOTES), None
        vectors, notes = self._held(profile, info["runs"])
        checked = F.when(valid_vector(F.col("vector"), info["dimensions"]), F.col("vector")).otherwise(_no_vector())
        return vectors.select("key", checked.alias("vector")), notes, info

    def refresh(self, notes: DataFrame, chunks: DataFrame, profile: str, embed: Callable[[DataFrame], DataFrame], rescan: Callable[[], DataFrame] | None = None, rebuild: bool = False) -> dict:
        """Embed missing passages (``embed``: key, passage to key, vector), keep fresh vectors, leave out vanished ones."""
        info = None if rebuild else self.version(profile)
        runs = info["runs"] if info else []
        vectors, old = self._held(profile, runs) if runs else (self.spark.createDataFrame([], VECTORS), self.spark.createDataFrame([], NOTES))
        run = uuid.uuid4().hex
        at = self._at(profile, "runs", run)
        try:
            fresh = embed(missing(chunks, vectors)).select("key", F.col("vector").cast("array<double>").alias("vector"))
            unit = F.when(valid_vector(F.col("vector")), normalised(F.col("vector"))).otherwise(_no_vector())
            fresh.select("key", unit.alias("vector")).write.parquet(f"{at}/vectors")
            vectors.select("key").join(chunks.select("key"), "key", "left_anti").write.parquet(f"{at}/gone")
            both = notes.select("path", F.col("fingerprint").alias("now")).join(old.select("path", F.col("fingerprint").alias("was")), "path", "full_outer")
            both.filter(~F.col("now").eqNullSafe(F.col("was"))).select("path", F.col("now").alias("fingerprint")).write.parquet(f"{at}/notes")
            new = self._runs(profile, [run], "vectors", VECTORS).agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.count("*").alias("n")).first()
            sizes = {new["least"], new["most"], (info or {}).get("dimensions")} - {None}
            if len(sizes) > 1:
                raise ValueError(f"vectors of different sizes: {', '.join(map(str, sorted(sizes)))}")
            gone = self._runs(profile, [run], "gone", GONE).count()
            removed = self._runs(profile, [run], "notes", NOTES).filter("fingerprint is null").count()
            if rescan is not None and any(manifest_changes(rescan(), notes).first()):
                raise ValueError("notes were changed while they were indexed; the index is as it was")
            live = (info["vectors"] if info else 0) - gone + new["n"]
            held = (info["held"] if info else 0) + new["n"]
            number = max(self.versions(profile), default=0) + 1
            runs = [*runs, run]
            if len(runs) > MOST_RUNS or held > 2 * live + 1:
                runs, held = [self._together(profile, runs)], live
            out = {"version": number, "runs": runs, "vectors": live, "held": held, "dimensions": next(iter(sizes), None), "embedded_chunks": new["n"], "reused_chunks": live - new["n"], "removed_notes": removed}
            self._publish(profile, out)
        except BaseException:
            self._drop(at)
            raise
        self._clean(profile, number, rebuild)
        return out

    def _together(self, profile: str, runs: list[str]) -> str:
        """What several runs amount to, written as one."""
        run = uuid.uuid4().hex
        vectors, notes = self._held(profile, runs)
        for name, table in (("vectors", vectors), ("notes", notes), ("gone", vectors.select("key").limit(0))):
            table.write.parquet(self._at(profile, "runs", run, name))
        return run

    def _publish(self, profile: str, info: dict) -> None:
        """Write the version's file aside and give it its name, unless another writer's version has it."""
        name = self._at(profile, "versions", f"{info['version']:012}.json")
        aside = self._at(profile, "versions", f".{uuid.uuid4().hex}")
        fs, source = self._fs(aside)
        out = fs.create(source, False)
        out.write(bytearray(json.dumps(info).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(source, hadoop.Path(name), none)  # never onto a file that's there
        except Exception as e:
            fs.delete(source, False)
            if "AlreadyExists" in str(e):
                raise ValueError("another refresh was published first; this one changed nothing") from e
            raise

    def _clean(self, profile: str, number: int, rebuild: bool) -> None:
        """Delete what only versions before the last but one are made of; after a rebuild the other profiles, too."""
        old = [v for v in self.versions(profile) if v < number - 1]
        needed = {r for v in self.versions(profile) if v >= number - 1 for r in self.version(profile, v)["runs"]}
        for v in old:
            for r in self.version(profile, v)["runs"]:
                if r not in needed:
                    self._drop(self._at(profile, "runs", r))
            self._drop(self._at(profile, "versions", f"{v:012}.json"))
        for other in self._listed(self.root) if rebuild else ():
            if other.startswith("profile=") and other != f"profile={profile}":
                self._drop(f"{self.root}/{other}")


def _no_vector() -> Column:
    return F.raise_error(F.lit("an embedding is not finite, or without direction")).cast("array<double>")
