"""Annotated sessions: manifests and annotations in JSON, candidate tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, DoubleType, FloatType, MapType, StructType

from ..plans.classify import FEATURES
from .sinks import write_text_table

_INTERVAL = "array<struct<rep_number:bigint,start_time:double,end_time:double,confidence:string,note:string>>"
MANIFEST = "session_id string, participant_id string, recording_csv string, calibration_csv string, planned_reps bigint, exercise_metadata map<string,string>, recording_started_at string, created_at string, notes string"
ANNOTATIONS = f"annotation_status string, actual_reps bigint, verified_rep_intervals {_INTERVAL}, excluded_false_intervals {_INTERVAL}, confidence double, notes string, last_modified string"
#: Fixed: the columns of the candidate table, in order.
CANDIDATE_COLUMNS = (
    "session_id", "recording_filename", "participant_id", "exercise", "side", "weight", "candidate_timestamp", *FEATURES,
    "hybrid_status", "human_label", "matched_human_boundary_timestamp", "matching_error", "matched_boundary_index", "annotation_confidence",
)


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files as ``folder, d``: the name of the folder a file lies in and its content; files that are no JSON are left out."""
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    text = spark.read.text(path, wholetext=True).select(F.col("value"), folder.alias("folder"))
    whole = F.from_json("value", f"struct<{schema}, _bad string>", {"columnNameOfCorruptRecord": "_bad"})
    return text.select("folder", whole.alias("d")).filter("d is not null and d._bad is null")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a store with a folder each: the manifest's columns and those of its annotations.

    A session without annotations is ``unreviewed`` and has none; a manifest that
    is no JSON is left out.
    """
    manifests = _documents(spark, f"{path}/*/manifest.json", MANIFEST).select("folder", "d.*").drop("_bad")
    notes = _documents(spark, f"{path}/*/annotations.json", ANNOTATIONS).select("folder", F.col("d").dropFields("_bad").alias("annotations"))
    joined = manifests.join(notes, "folder", "left").withColumn("session_id", F.coalesce("session_id", "folder"))
    status = F.coalesce("annotations.annotation_status", F.lit("unreviewed"))
    rows = lambda c: F.coalesce(F.col(f"annotations.{c}"), F.array().cast(_INTERVAL)).alias(c)
    return joined.select(*[c for c in manifests.columns if c != "folder"], status.alias("annotation_status"), "annotations.actual_reps", rows("verified_rep_intervals"), rows("excluded_false_intervals"))


def manifests(sessions: DataFrame, cues: DataFrame, intervals: DataFrame) -> DataFrame:
    """One nested row a session: its own columns, its cues in order, and the intervals of each detector (``detector``) in order."""
    at = F.struct("start_time", "end_time", "rep", "phase")
    said = cues.groupBy("session_id").agg(F.sort_array(F.collect_list(at)).alias("cue_timestamps"))
    reps = F.sort_array(F.collect_list(F.struct("start_time", "end_time", "peak_time", "peak_value")))
    found = intervals.groupBy("session_id").pivot("detector", ["threshold", "valley"]).agg(reps)
    return sessions.join(said, "session_id", "left").join(found, "session_id", "left")


def write_candidates(rows: DataFrame, path: str) -> None:
    """Candidates in the order of ``CANDIDATE_COLUMNS``, what is unknown as an empty text; an existing table stays until the new one is whole, then is replaced."""
    write_text_table(rows.select(*CANDIDATE_COLUMNS), path)


def write_skip_report(sessions: DataFrame, path: str) -> None:
    """What :func:`skip_report` gives, written like the candidates."""
    write_text_table(skip_report(sessions), path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A candidate table as text; a missing column is an error."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    if missing := [c for c in CANDIDATE_COLUMNS if c not in rows.columns]:
        raise ValueError(f"candidate table lacks {missing}")
    return rows.select(*CANDIDATE_COLUMNS)


def skip_report(sessions: DataFrame) -> DataFrame:
    """``session_id, reason`` of what :func:`~tidewater.operators.matching.eligibility` refuses."""
    return sessions.filter("reason != 'eligible'").select("session_id", "reason")


def row_keys(rows: DataFrame, *order: str) -> DataFrame:
    """``row_key``: the place among all rows of the session's, so that equal timestamps are told apart, as ``session:place:timestamp``."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1
    return rows.withColumn("row_key", F.concat_ws(":", F.col("session_id").cast("string"), place.cast("string"), F.col("candidate_timestamp").cast("string")))


def _plain(c: Column, kind: DataType) -> Column:
    """A value with the keys of its objects in order and null for each number that is not finite, at any depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, StructType):
        inner = [_plain(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*inner)) if inner else c
    if isinstance(kind, MapType):
        return F.transform_values(F.map_from_entries(F.array_sort(F.map_entries(c))), lambda _, v: _plain(v, kind.valueType)) if isinstance(kind.valueType, AtomicType) else F.transform_values(c, lambda _, v: _plain(v, kind.valueType))
    return c


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Every row as one JSON document, its objects' keys in order at every depth; numbers that are not finite are null.

    Keys of maps are put in order where their values can be compared.
    """
    plain = [_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(rows.schema.fields, key=lambda f: f.name)]
    return rows.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias(name))
