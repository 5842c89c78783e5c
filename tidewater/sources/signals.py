"""Recordings as tables: CSV readers, serial lines, clocks, and views of event tables as recordings.

A recording is a set of rows ``recording_id, seq, time_s, raw``; every operator
works on many recordings at once and shuffles them by ``recording_id`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Names a value column may have, in order of preference.
VALUE_COLUMNS = ("signal_value", "emg_value")
CLOCK_PERIOD = 2**32


def _raw_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, str]:
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    for name in VALUE_COLUMNS:
        if name in df.columns:
            return df, name
    raise ValueError(f"no value column: expected one of {VALUE_COLUMNS}, found {df.columns}")


def _in_file_order(df: DataFrame) -> DataFrame:
    """``seq`` numbers the rows of a file in the order they have in it."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    marked = df.withColumns({"recording_id": stem, "_at": F.monotonically_increasing_id()})
    order = Window.partitionBy("recording_id").orderBy("_at")
    return marked.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).drop("_at")


def read_signals(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Strict scan: a cell that is no number raises when it is read; rows keep the order of the file, never that of time."""
    df, value = _raw_csv(spark, path)
    rows = _in_file_order(df)
    return rows.select("recording_id", "seq", (F.col("time_ms").cast("double") / 1000).alias("time_s"), F.col(value).cast("double").alias("raw"))


def read_replay(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lenient scan: rows with a bad or missing time or value go; the text of the value stays as ``raw_sample``."""
    df, value = _raw_csv(spark, path)
    good = df.select("*", "_metadata").filter(F.expr("try_cast(time_ms as double)").isNotNull() & F.expr(f"try_cast({value} as double)").isNotNull())
    rows = _in_file_order(good)
    return rows.select("recording_id", "seq", (F.col("time_ms").cast("double") / 1000).alias("time_s"), F.col(value).cast("double").alias("raw"), F.col(value).alias("raw_sample"))


def require_rows(signals: DataFrame, recordings: DataFrame) -> DataFrame:
    """Recordings of ``recordings`` without a single row in ``signals``, for callers that have to refuse them."""
    return recordings.join(signals.select("recording_id").distinct(), "recording_id", "left_anti")


#: What counts as a number in a line: a decimal number, or for the value also "inf" and "nan".
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_VALUE = rf"{_NUMBER}|^[+-]?(?i:inf|infinity|nan)$"


def parse_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """Serial text lines, ``value`` or ``device ms,...,value``: adds ``device_time_ms`` and ``value``.

    Empty fields don't count.  Both are null if the last field is no number; a
    first field that is none leaves only the time null.  The time is cut to whole
    milliseconds, the value is kept as it is.
    """
    parts = F.filter(F.transform(F.split(F.col(col), ","), lambda p: F.trim(p)), lambda p: p != "")
    number = lambda c, pattern: F.when(c.rlike(pattern), c.try_cast("double"))
    value = number(F.get(parts, F.size(parts) - 1), _VALUE)
    time = F.when((F.size(parts) >= 2) & value.isNotNull(), number(F.get(parts, F.lit(0)), _NUMBER))
    return lines.withColumns({"device_time_ms": time.cast("long"), "value": value})


@dataclass
class Clock:
    """What is remembered of a clock between readings: its last time that counted and what its rollovers add up to."""

    period: int = CLOCK_PERIOD
    last: int | None = None
    turns: int = 0

    def read(self, t: int | None) -> int | None:
        """The time without rollovers; null if it is missing or goes back, and then nothing changes."""
        if t is not None and self.last is not None and self.last - t > self.period // 2:
            self.turns += self.period
            self.last = None
        if t is None or self.last is not None and t < self.last:
            return None
        self.last = t
        return int(t) + self.turns


def unwrap_clock(readings: DataFrame, time_col: str = "device_time_ms", key: str = "recording_id", order: str = "seq", period: int = CLOCK_PERIOD) -> DataFrame:
    """``device_time_ms`` without the rollovers of a clock: a fall by more than half the period adds one period.

    A time that then still goes back is null and counts for nothing, and so is a
    missing one.  What a reading becomes depends on the last one that counted, so
    each recording is read once in order, with two numbers at hand.
    """
    at, by = readings.columns.index(time_col), readings.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, clock = object(), Clock(period)
        for b in batches:
            made: list[int | None] = []
            for k, t in zip(b.column(by).to_pylist(), b.column(at).to_pylist()):
                if k != now:
                    now, clock = k, Clock(period)
                made.append(clock.read(t))
            columns = list(b.columns)
            columns[at] = pa.array(made, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    schema = StructType([StructField(time_col, LongType()) if i == at else f for i, f in enumerate(readings.schema.fields)])
    return readings.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def as_recordings(df: DataFrame, key: str | Column, order: list[str], value: str, step_s: float = 0.1) -> DataFrame:
    """Any ordered table as recordings sampled every ``step_s`` seconds."""
    w = Window.partitionBy("recording_id").orderBy(*order)
    keyed = df.withColumn("recording_id", F.col(key) if isinstance(key, str) else key)
    seq = (F.row_number().over(w) - 1).cast("long")
    return keyed.select("recording_id", seq.alias("seq"), F.col(value).cast("double").alias("raw")).select("recording_id", "seq", (F.col("seq") * F.lit(step_s)).alias("time_s"), "raw")


def event_recordings(spark: SparkSession, sf_dir: str, step_s: float = 0.1) -> DataFrame:
    return as_recordings(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], "value", step_s)


def supplier_recordings(spark: SparkSession, sf_dir: str, step_s: float = 0.1) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    return as_recordings(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", order, "l_extendedprice", step_s)


def write_recordings(signals: DataFrame, path: str, buckets: int = 64) -> None:
    """Recordings as Parquet in ``buckets`` files' worth of hash partitions, each sorted by recording and row; an existing path is refused."""
    signals.repartition(buckets, "recording_id").sortWithinPartitions("recording_id", "seq").write.mode("errorifexists").parquet(path)


def read_metadata(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON sidecars as ``recording_id`` and a map of strings; the suffix ``_metadata`` of the file's name is dropped."""
    text = spark.read.text(path, wholetext=True).select("value", F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:_metadata)?\.json$", 1).alias("recording_id"))
    return text.select("recording_id", F.from_json("value", "map<string,string>").alias("metadata"))
