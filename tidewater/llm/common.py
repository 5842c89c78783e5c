"""Helpers shared by the corpus operators: tables, shared scratch and words."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, a laptop)
    is a temporary one set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "cut", by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, and a lost executor costs a re-read.

    With ``by``, a column of few values, each value has a folder of its own.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _free_shuffles(spark)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path, None
    return made


def _free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more are only freed when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def materialize_bucketed(df: DataFrame, label: str, by: list[str], buckets: int) -> DataFrame:
    """Like :func:`materialize`, but as a table bucketed and sorted by ``by``, so that joins by these columns need no shuffle.

    ``df`` should come from an aggregation or join by ``by``; then each bucket is written by one task.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *by).sortBy(*by).option("path", f"{scratch_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    _free_shuffles(spark)
    return bucketed(spark, name)


def bucketed(spark: SparkSession, name: str) -> DataFrame:
    """A table made by :func:`materialize_bucketed`, by its name."""
    made = spark.table(name)
    made._scratch = f"{scratch_dir(spark)}/{name}", name
    return made


def scratch_name(df: DataFrame) -> str:
    """The name of a table made by :func:`materialize_bucketed`."""
    return df._scratch[1]


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` or :func:`materialize_bucketed` that nothing reads any more."""
    spark, (folder, name) = df.sparkSession, df._scratch
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str, **options) -> DataFrame:
    """``mapInArrow`` for a function from one batch to one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is None or not out.num_rows:
                continue
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema, **options)


def annotate(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` with columns computed batch by batch in Python.

    ``fn`` gets an Arrow batch and returns the arrays named in the DDL string
    ``added``.  Only the columns in ``keep`` (all of them by default) travel back
    from Python; input columns named like an added one are replaced.
    """
    new = df.sparkSession.createDataFrame([], added).schema
    back = without(df, *new.names).columns if keep is None else keep
    schema = type(new)([f for f in df.schema.fields if f.name in back] + list(new.fields))
    names = [f.name for f in new.fields]
    order = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([made[n] if n in names else batch.column(n) for n in order], names=order)

    return df.mapInArrow(run, schema)
