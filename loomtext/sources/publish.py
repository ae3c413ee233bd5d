"""Published tables: written aside, looked through, then made the current version by one rename; and the store of projects."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup
from ..operators.stages import file_system, is_committed

#: Reasons that a refusal names.
MOST_NAMED = 20


class Refused(Exception):
    """Nothing was published, and why."""


class Conflict(Exception):
    """Another writer published first."""


def _version(spark: SparkSession, folder: str, number: int) -> str:
    return f"{folder}/v={number:08d}"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions that are whole, in order."""
    p, fs = file_system(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    return [n for n in found if is_committed(spark, _version(spark, folder, n))]


def current(spark: SparkSession, folder: str) -> int:
    """The number of the newest version; 0: none."""
    return max(versions(spark, folder), default=0)


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The newest version, or one that came before it."""
    number = current(spark, folder) if number is None else number
    if number not in versions(spark, folder):
        raise FileNotFoundError(f"{folder} has no version {number}")
    return spark.read.parquet(_version(spark, folder, number))


def publish(rows: DataFrame, folder: str, audit: Callable[[DataFrame], None] | None = None, based_on: int | None = None) -> int:
    """Writes rows as the next version of folder and gives its number. Earlier versions stay.

    The rows are written aside first; audit() looks at what was written and may raise, and then, or when the write fails, readers never
    see any of it. Who comes first takes a number, by a file that only one can make; with based_on, nothing is published unless
    that is still the newest version.
    """
    spark = rows.sparkSession
    aside = f"{folder}/.aside-{uuid.uuid4().hex}"
    p, fs = file_system(spark, aside)
    try:
        rows.write.parquet(aside)
        if audit:
            audit(spark.read.parquet(aside))
        now = current(spark, folder)
        if based_on is not None and now != based_on:
            raise Conflict(f"{folder} is at version {now}, not {based_on}")
        number = now + 1
        claim, _ = file_system(spark, f"{folder}/.claims/{number:08d}")
        if not fs.createNewFile(claim):
            raise Conflict(f"version {number} of {folder} is being written by another")
        target, _ = file_system(spark, _version(spark, folder, number))
        if fs.exists(target) or not fs.rename(p, target):
            fs.delete(claim, False)
            raise Conflict(f"version {number} of {folder} could not be put in place")
        return number
    finally:
        fs.delete(p, True)


def source_changes(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(path, reason): sources of projects (path, source_hash) that are not what they were; files are (path, content)."""
    now = files.select("path", F.sha2("content", 256).alias("_now"))
    rows = projects.select("path", "source_hash").join(now, "path", "left")
    reason = F.when(F.col("_now").isNull(), "the source is gone").when(F.lower(F.regexp_replace("source_hash", "^(?i)sha256:", "")) != F.col("_now"), "the source was edited after the project was made")
    return rows.select("path", reason.alias("reason")).where("reason is not null")


def untranslated_reasons(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason): what of the segments (keys, block_id, part, parts, chunk_index, state, final) has no translation."""
    report = rollup.untranslated(segments, keys, rollup.translations(segments, keys))
    said = lambda name: F.when(F.col(name) != "", F.concat(F.lit(f"; {name}: "), F.col(name))).otherwise("")
    return report.where("blocks > 0").select(*keys, F.concat(F.col("blocks").cast("string"), F.lit(" untranslated blocks"), *map(said, ("failed", "running", "pending"))).alias("reason"))


def _refuse(reasons: DataFrame, keys: list[str]) -> None:
    first = reasons.orderBy(*keys).limit(MOST_NAMED + 1).collect()
    if first:
        named = [f"{', '.join(str(r[k]) for k in keys)}: {r.reason}" for r in first[:MOST_NAMED]]
        raise Refused("; ".join(named) + (" and more" if len(first) > MOST_NAMED else ""))


def export(segments: DataFrame, projects: DataFrame, files: DataFrame, folder: str, allow_partial: bool = False) -> int:
    """Publishes the translations (path, block_id, text) of all projects, or raises Refused: a source is not what it was, or, unless
    allow_partial, a block has no translation. Sources are looked at again after the write, so one that changes meanwhile is seen."""
    keys = ["path"]
    _refuse(source_changes(projects, files), keys)
    if not allow_partial:
        _refuse(untranslated_reasons(segments, keys), keys)
    return publish(rollup.translations(segments, keys), folder, audit=lambda _: _refuse(source_changes(projects, files), keys))


def replace_source(projects: DataFrame, folder: str, based_on: int) -> int:
    """The next version of a project table; the one before it stays as the backup, and a table that another refresh replaced first is a Conflict."""
    return publish(projects, folder, based_on=based_on)


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files of no length at path, a file, a folder or a pattern: Spark's readers pass over them. Only names come to the driver."""
    p, fs = file_system(spark, path)
    out, left = [], list(fs.globStatus(p) or [])
    while left:
        s = left.pop()
        if s.isDirectory():
            left += list(fs.listStatus(s.getPath()))
        elif s.getLen() == 0 and not s.getPath().getName().startswith(("_", ".")):
            out.append(s.getPath().toString())
    return sorted(out)


def read_projects(spark: SparkSession, path: str, schema: str, newest: str = "updatedAt") -> tuple[DataFrame, DataFrame]:
    """(projects, broken) of JSON files: the projects, newest first, with file_path; and (file_path, reason) of files that are no project.

    One broken or empty file does not stop the scan, and none goes unseen. A file that is read but has no value in the newest column is
    broken too.
    """
    found = spark.read.schema(f"{schema}, _broken string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = found.withColumn("file_path", F.col("_metadata.file_path"))
    rows = rows.withColumn("_reason", F.when(F.col("_broken").isNotNull(), "not JSON of this form").when(F.col(newest).isNull(), f"no {newest}"))
    empty = spark.createDataFrame([(f, "empty") for f in _empty_files(spark, path)], "file_path string, reason string")
    broken = rows.where("_reason is not null").select("file_path", F.col("_reason").alias("reason")).unionByName(empty)
    return rows.where("_reason is null").drop("_broken", "_reason").orderBy(F.desc(newest), "file_path"), broken
