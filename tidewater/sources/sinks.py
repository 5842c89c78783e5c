"""Sinks with one commit: a folder appears whole or not at all.

Every task attempt writes into a folder of its own below a hidden staging folder
beside the target.  When all tasks are done, the driver moves the folders of the
attempts that succeeded together and renames the result to the target; it
handles one folder a task, never a row.  A failed job removes the staging
folder, which an attempt that still runs cannot make again; what attempts that
were killed have left is never moved.

Committed recordings are read back the same way: the driver lists one folder a
task, each task lists and reads the files of its folders.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed: the columns of a recording's file, in order.
RECORDING_COLUMNS = ("time_ms", "host_time_ms", "device_time_ms", "host_elapsed_ms", "timing_drift_ms", "emg_value", "raw_serial_sample")
_SIDECAR = "_metadata.json"
#: Fixed: rows that are sent together, and bytes of a file that are parsed together, which no line exceeds.
BATCH_ROWS, BLOCK_BYTES = 10_000, 8 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    system, p = _at(path)
    return system.get_file_info(p).type != fs.FileType.NotFound


def _remove(system: fs.FileSystem, folder: str, tries: int = 20) -> None:
    """Delete a folder into which attempts that are being killed may still write."""
    for left in reversed(range(tries)):
        if system.get_file_info(folder).type == fs.FileType.NotFound:
            return
        try:
            system.delete_dir(folder)
        except OSError:
            if not left:
                raise
            time.sleep(0.1)


@dataclass
class _Part(WriterCommitMessage):
    number: int
    folder: str | None
    rows: int


class _Staged(DataSourceWriter):
    """Writes tasks' folders and commits them; subclasses write the files of one."""

    def __init__(self, path: str, schema: StructType, replace: bool):
        self.path, self.schema, self.replace = path.rstrip("/"), schema, replace
        top, _, name = self.path.rpartition("/")
        self.staging = f"{top}/.{name}-{uuid.uuid4().hex}"
        if not replace and exists(self.path):
            raise FileExistsError(f"{self.path} exists")
        system, staging = _at(self.staging)
        system.create_dir(f"{staging}/attempts", recursive=True)

    def files(self, rows: Iterator[Row], folder: str, system: fs.FileSystem) -> int:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> _Part:
        system, staging = _at(self.staging)
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        folder = f"{staging}/attempts/{number}-{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=False)
        try:
            n = self.files(iterator, folder, system)
        except BaseException:
            _remove(system, folder)
            raise
        return _Part(number, folder, n)

    def commit(self, messages: list[_Part | None]) -> None:
        system, staging = _at(self.staging)
        _, target = _at(self.path)
        done = f"{staging}/done"
        system.create_dir(done, recursive=True)
        for m in messages:
            if m is not None and m.rows:
                system.move(m.folder, f"{done}/part-{m.number:05d}")
        old = None
        if exists(self.path):
            if not self.replace:
                self.abort(messages)
                raise FileExistsError(f"{self.path} was made by another while this was written")
            old = f"{staging}/old"
            system.move(target, old)
        try:
            system.move(done, target)
        except BaseException:
            if old:
                system.move(old, target)
            raise
        _remove(system, staging)

    def abort(self, messages: list[_Part | None]) -> None:
        _remove(*_at(self.staging))


def _fixed(x: float | None) -> str:
    return "" if x is None else f"{x:.3f}"


def _whole(x: float | None) -> str:
    return "" if x is None else str(int(x))


#: How the columns of a recording's file are written.
_FORMS = (_fixed, _whole, _whole, _fixed, _fixed, None, None)


class _RecordingWriter(_Staged, DataSourceArrowWriter):
    """A CSV of seven columns and a JSON sidecar for each recording; rows come sorted by recording, the metadata first."""

    def files(self, batches: Iterator[pa.RecordBatch], folder: str, system: fs.FileSystem) -> int:
        out, now, n = None, None, 0
        try:
            for b in batches:
                sides, at = b.column("metadata").to_pylist(), 0
                texts = [[form(x) for x in b.column(c).to_pylist()] if form else b.column(c).to_pylist() for c, form in zip(RECORDING_COLUMNS, _FORMS)]
                cells = list(zip(*texts))
                for recording, run in itertools.groupby(b.column("recording_id").to_pylist()):
                    end = at + sum(1 for _ in run)
                    name = quote(str(recording), safe=" ")
                    if out is None or recording != now:
                        if out is not None:
                            out.close()
                        now = recording
                        out = io.TextIOWrapper(system.open_output_stream(f"{folder}/{name}.csv"), encoding="utf-8", newline="")
                        lines = csv.writer(out)
                        lines.writerow(RECORDING_COLUMNS)
                        n += 1
                    for metadata in filter(None, sides[at:end]):
                        with system.open_output_stream(f"{folder}/{name}{_SIDECAR}") as side:
                            side.write((json.dumps(json.loads(metadata), indent=2) + "\n").encode())
                    lines.writerows(cells[i] for i in range(at, end) if sides[i] is None)
                    at = end
        finally:
            if out is not None:
                out.close()
        return n


class _RecordingReader(DataSourceReader):
    """What :class:`_RecordingWriter` has committed, a folder of it a task; subclasses read the files of one."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def files(self, listed: list[fs.FileInfo], system: fs.FileSystem) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        system, path = _at(self.path)
        return [InputPartition(p) for p in sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-"))]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was committed
            return
        system, _ = _at(self.path)
        some, n = [], 0
        for b in self.files(system.get_file_info(fs.FileSelector(partition.value)), system):
            some.append(b)
            n += b.num_rows
            if n >= BATCH_ROWS:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some, n = [], 0
        if some:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()


class _SampleReader(_RecordingReader):
    """``recording_id, seq, time_ms, emg_value`` of the CSVs, the last two as texts; ``seq`` numbers the rows of a file."""

    SCHEMA = "recording_id string, seq long, time_ms string, emg_value string"

    def files(self, listed: list[fs.FileInfo], system: fs.FileSystem) -> Iterator[pa.RecordBatch]:
        kept = ["time_ms", "emg_value"]
        convert = arrow_csv.ConvertOptions(column_types=dict.fromkeys(kept, pa.string()), include_columns=kept, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False)
        options = arrow_csv.ReadOptions(use_threads=False, block_size=BLOCK_BYTES), arrow_csv.ParseOptions(newlines_in_values=True), convert
        for f in listed:
            if f.base_name.endswith(".csv"):
                name, at = pa.scalar(unquote(f.base_name.removesuffix(".csv"))), 0
                with system.open_input_stream(f.path) as file, arrow_csv.open_csv(file, *options) as blocks:
                    for b in blocks:
                        seq = pa.array(np.arange(at, at + b.num_rows))
                        yield pa.RecordBatch.from_arrays([pa.repeat(name, b.num_rows), seq, *b.columns], names=["recording_id", "seq", *kept])
                        at += b.num_rows


class _SidecarReader(_RecordingReader):
    """``recording_id, value``: the texts of the sidecars."""

    SCHEMA = "recording_id string, value string"

    def files(self, listed: list[fs.FileInfo], system: fs.FileSystem) -> Iterator[pa.RecordBatch]:
        for some in itertools.batched((f for f in listed if f.base_name.endswith(_SIDECAR)), BATCH_ROWS // 10):
            texts = []
            for f in some:
                with system.open_input_stream(f.path) as file:
                    texts.append(file.read().decode())
            names = [unquote(f.base_name.removesuffix(_SIDECAR)) for f in some]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["recording_id", "value"])


class _TextWriter(_Staged):
    """A CSV with a header for each task, nulls as empty texts."""

    def files(self, rows: Iterator[Row], folder: str, system: fs.FileSystem) -> int:
        n = 0
        with io.TextIOWrapper(system.open_output_stream(f"{folder}/rows.csv"), encoding="utf-8", newline="") as out:
            lines = csv.writer(out)
            lines.writerow(self.schema.names)
            for r in rows:
                lines.writerow(["" if x is None else x for x in r])
                n += 1
        # a table without rows still has its header, from the first task
        return n or int(folder.rpartition("/")[2].startswith("0-"))


class CommittedRecordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_recordings"

    def _reader(self) -> type[_RecordingReader]:
        return _SidecarReader if self.options.get("files") == "sidecars" else _SampleReader

    def schema(self) -> str:
        return self._reader().SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return self._reader()(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _RecordingWriter(self.options["path"], schema, overwrite)


class CommittedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_text"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _TextWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommittedRecordings)
    spark.dataSource.register(CommittedText)


def write_recordings_once(samples: DataFrame, metadata: DataFrame, path: str) -> None:
    """A file of samples and one of metadata for each recording, all in one commit; an existing path is refused.

    ``samples`` has ``recording_id, seq`` and the columns of a file, ``metadata``
    has ``recording_id`` and a map.  A recording without samples has a file with
    a header only, one without metadata has no sidecar.  ``metadata`` has a row a
    recording; of several, one is taken.  Recordings lie in ``part-*`` folders.
    """
    register(samples.sparkSession)
    kinds = dict(zip(RECORDING_COLUMNS, ("double", "double", "double", "double", "double", "string", "string")))
    key = F.col("recording_id").cast("string").alias("recording_id")
    sides = metadata.filter("metadata is not null").dropDuplicates(["recording_id"])
    sides = sides.select(key, F.lit(None).cast("long").alias("seq"), *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()], F.to_json("metadata").alias("metadata"))
    rows = samples.select(key, F.col("seq").cast("long"), *[F.col(c).cast(k).alias(c) for c, k in kinds.items()], F.lit(None).cast("string").alias("metadata"))
    dealt = rows.unionByName(sides).repartition("recording_id").sortWithinPartitions("recording_id", F.col("metadata").isNull(), "seq")
    dealt.write.format("committed_recordings").mode("append").save(path)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a committed path as :func:`signals.read_signals` gives them: strict, rows in the order of the file."""
    register(spark)
    rows = spark.read.format("committed_recordings").load(path)
    return rows.select("recording_id", "seq", (F.col("time_ms").cast("double") / 1000).alias("time_s"), F.col("emg_value").cast("double").alias("raw"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecars of a committed path as :func:`signals.read_metadata` gives them: ``recording_id`` and a map of strings."""
    register(spark)
    texts = spark.read.format("committed_recordings").option("files", "sidecars").load(path)
    return texts.select("recording_id", F.from_json("value", "map<string,string>").alias("metadata"))


def write_text_table(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header, what is unknown as an empty text, in place of what is at ``path``, which stays until the new table is whole."""
    register(rows.sparkSession)
    rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns]).write.format("committed_text").mode("overwrite").save(path)
