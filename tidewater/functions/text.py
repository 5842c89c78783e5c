"""Names, sizes, extracted fields, report lines and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slug(c: Column, fallback: str = "unknown") -> Column:
    """Lower case, every run of anything else than ``a-z0-9`` as one underscore, none at the ends."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))


def safe_name(c: Column, fallback: str = "unknown") -> Column:
    """Letters and digits of any script in lower case, every other character an underscore, none at the ends; runs stay."""
    out = F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")), "^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))


def file_size(bytes_: Column) -> Column:
    return F.when(bytes_ < 1024, F.format_string("%d B", bytes_.cast("long"))).when(bytes_ < 1024**2, F.format_string("%.1f KB", bytes_ / F.lit(1024.0))).otherwise(F.format_string("%.1f MB", bytes_ / F.lit(1024.0**2)))


def number_of(c: Column) -> Column:
    """``'12.3%'`` or ``'4s'`` as a number, null for anything else."""
    return F.regexp_replace(F.trim(c), "[%s]$", "").try_cast("double")


def labelled_value(c: Column, label: str) -> Column:
    """What follows ``label:`` on a line of its own; null where there is no such line."""
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?m)^{label}:\s*(.+)$", 1)), F.lit(""))


def stamp(c: Column) -> Column:
    """A time as ``20240131_235959``."""
    return F.date_format(c, "yyyyMMdd_HHmmss")


def date_time(c: Column) -> Column:
    """A time as ``2024-01-31 11:59 PM``."""
    return F.date_format(c, "yyyy-MM-dd hh:mm a")


def session_ids(sessions: DataFrame) -> DataFrame:
    """``session_id`` from the time of making, the participant and the exercise; equal ones get ``_2``, ``_3`` and so on in the order of ``row_no``."""
    base = F.concat_ws("_", stamp(F.col("created_at")), slug(F.col("participant_id").cast("string")), slug(F.col("exercise")))
    n = F.row_number().over(Window.partitionBy("_base").orderBy("row_no"))
    named = sessions.withColumn("_base", base).withColumn("_n", n)
    return named.withColumn("session_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def section(c: Column, header: str) -> Column:
    """The lines of a text between a line that is ``header`` and the next empty line or the end; null without it."""
    return F.nullif(F.regexp_extract(c, rf"(?ms)^{header}[ \t]*\n(.*?)(?=\n[ \t]*\n|\Z)", 1), F.lit(""))


def category(data_type: Column, test_type: Column) -> Column:
    return (
        F.when(data_type == "synthetic", "synthetic").when(data_type == "fake", "simulated").when(test_type == "calibration", "calibration")
        .when(test_type == "workout_set", "workout").when(test_type == "flex_test", "flex test").otherwise("unknown")
    )


def cue_schedule(plans: DataFrame) -> DataFrame:
    """``session_id, rep, phase, start_time, end_time`` from ``reps`` and the lengths of lift, hold, lower and rest; phases without length are left out."""
    phases = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(p).alias("phase"), F.col(p).alias("duration")) for i, p in enumerate(("lift", "hold", "lower", "rest"))])
    rows = plans.select("session_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps").cast("long"))).alias("rep"), phases.alias("p"))
    rows = rows.select("session_id", "rep", F.explode("p").alias("x")).select("session_id", "rep", "x.*").filter("duration > 0")
    w = Window.partitionBy("session_id").orderBy("rep", "k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("duration").over(w)
    return rows.select("session_id", "rep", "phase", F.round(end - F.col("duration"), 3).alias("start_time"), F.round(end, 3).alias("end_time"))
