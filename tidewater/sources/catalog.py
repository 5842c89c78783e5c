"""The catalogue of recordings: files with their metadata, which of them count, what is stale, and whether sources stayed as they were.

Metadata fields are plain columns of text; one that a table lacks counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .signals import read_metadata

FIELDS = ("data_type", "test_type", "status", "include", "excluded", "notes", "exercise_name", "muscle", "side", "weight", "participant_id", "expected_reps", "calibration_csv", "calibration_setup_id", "calibration_status")
_MARKING = ("test_type", "status", "include", "excluded")


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``recording_id, path, mtime`` of every CSV at ``path``; contents are not read."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return listed.select(stem.alias("recording_id"), "path", F.col("modificationTime").alias("mtime"))


def with_metadata(recordings: DataFrame, metadata: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Recordings with the metadata of their name as columns, empty where there is none.  ``has_metadata`` tells which have."""
    value = lambda f: F.coalesce(F.try_element_at("_m", F.lit(f)), F.lit("")).alias(f)
    named = metadata.select("recording_id", F.col("metadata").alias("_m"))
    joined = recordings.drop(*fields).join(named, "recording_id", "left")
    return joined.select("*", *[value(f) for f in fields], (F.coalesce(F.size("_m"), F.lit(0)) > 0).alias("has_metadata")).drop("_m")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every recording of a folder with its metadata sidecar."""
    return with_metadata(files(spark, path), read_metadata(spark, f"{path}/*_metadata.json"))


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def excluded(recordings: DataFrame) -> Column:
    """Whether a recording is marked as diagnostic, there or in its notes, or as excluded."""
    marks = F.lower(F.concat_ws(" ", *[_text(recordings, c) for c in _MARKING]))
    return F.contains(marks, F.lit("exclude")) | F.contains(F.concat_ws(" ", marks, F.lower(_text(recordings, "notes"))), F.lit("diagnostic"))


def workouts(recordings: DataFrame) -> DataFrame:
    """Real workout sets that are not excluded."""
    return recordings.filter((_text(recordings, "data_type") == "real") & (_text(recordings, "test_type") == "workout_set") & ~excluded(recordings))


def calibrations(recordings: DataFrame) -> DataFrame:
    return recordings.filter(_text(recordings, "test_type") == "calibration")


def newest(recordings: DataFrame, *keys: str) -> DataFrame:
    """The newest recording of each key; the smaller id wins ties."""
    last = recordings.groupBy(*keys).agg(F.max("mtime").alias("mtime"))
    return last.join(recordings, [*keys, "mtime"]).groupBy(*keys).agg(F.min("recording_id").alias("recording_id"))


def freshness(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """``recording_id, is_current``: whether a derived output is at least as new as its source; false without one."""
    out = outputs.groupBy("recording_id").agg(F.max("mtime").alias("_out"))
    return sources.join(out, "recording_id", "left").select("recording_id", F.coalesce(F.col("_out") >= F.col("mtime"), F.lit(False)).alias("is_current"))


def source_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, sha256`` of every source file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that came, went or changed between two calls of :func:`source_hashes`; none if a job left its sources alone."""
    return before.exceptAll(after).unionByName(after.exceptAll(before)).select("path").distinct()


def require_other_path(output: str, sources: DataFrame) -> None:
    """Refuse an output path that is one of the sources."""
    tail = output.split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    if sources.filter(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "").isin(tail, output)).limit(1).count():
        raise ValueError(f"the output {output} is a source")
