"""Sinks that commit once, recordings appended from a stream, nested JSON."""

import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewater import queries
from tidewater.sources import sessions, signals, sinks
from tidewater.streaming import recorder

SAMPLES = "recording_id string, seq long, time_ms double, host_time_ms double, device_time_ms double, host_elapsed_ms double, timing_drift_ms double, emg_value string, raw_serial_sample string"


def recordings(spark, n=3):
    rows = [(f"r{k}", i, i * 100.0004, 1000.9 + i, None if i == 1 else 7.0 + i, 0.5, None, f"{k * 10 + i}", f"{7 + i},{k * 10 + i}") for k in range(n) for i in range(40)]
    meta = [(f"r{k}", {"side": "left", "n": str(k)}) for k in range(n - 1)] + [("bare", {"side": "right"}), ("none", None)]
    return spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(meta, "recording_id string, metadata map<string,string>")


def below(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if not f.startswith("."))


def test_recordings_and_metadata_in_one_commit(spark, tmp_path):
    samples, meta = recordings(spark)
    path = str(tmp_path / "out")
    sinks.write_recordings_once(samples.orderBy(F.rand(3)), meta, path)
    assert below(path) == ["bare.csv", "bare_metadata.json", "r0.csv", "r0_metadata.json", "r1.csv", "r1_metadata.json", "r2.csv"]
    assert os.listdir(tmp_path) == ["out"]
    file = next(tmp_path.glob("out/*/r1.csv"))
    text = file.read_bytes().decode().split("\r\n")
    assert text[0] == "time_ms,host_time_ms,device_time_ms,host_elapsed_ms,timing_drift_ms,emg_value,raw_serial_sample"
    assert text[1] == '0.000,1000,7,0.500,,10,"7,10"' and text[2] == '100.000,1001,,0.500,,11,"8,11"' and len(text) == 42
    assert json.loads(next(tmp_path.glob("out/*/r1_metadata.json")).read_text()) == {"side": "left", "n": "1"}
    back = signals.read_signals(spark, f"{path}/*/r*.csv")
    assert back.count() == 120 and back.filter("recording_id = 'r2'").orderBy("seq").first().raw == 20.0
    assert {r.recording_id: r.metadata for r in signals.read_metadata(spark, f"{path}/*/*.json").collect()}["bare"] == {"side": "right"}


def test_committed_recordings_are_read_back_by_folder(spark, tmp_path):
    """No file of theirs is listed by the driver, whatever their number; names, rows, nulls and their order are what was written."""
    ids = ["a/b", "_x", "a_metadata", "ü 1%2F", "r.csv", *map(str, range(100))]
    rows = [(k, i, i * 100.0, None, None, None, None, None if i == 2 else f"{i}.25", 'say "x",\n\r\n' if i else None) for k in ids for i in range(5)]
    meta = [(k, {"id": k, "n": "1"}) for k in [*ids[:50], "bare"]]
    path = str(tmp_path / "out")
    sinks.write_recordings_once(spark.createDataFrame(rows, SAMPLES).orderBy(F.rand(3)), spark.createDataFrame(meta, "recording_id string, metadata map<string,string>"), path)
    back, sides = sinks.read_recordings(spark, path), sinks.read_sidecars(spark, path)
    assert back.inputFiles() == sides.inputFiles() == [] and back.rdd.getNumPartitions() == sides.rdd.getNumPartitions() == len(os.listdir(path)) < 10
    assert sorted(map(tuple, back.collect())) == sorted((k, i, i / 10, None if i == 2 else i + 0.25) for k in ids for i in range(5))
    assert sorted((r.recording_id, r.metadata["id"], r.metadata["n"]) for r in sides.collect()) == sorted((k, k, "1") for k, _ in meta)


def test_the_query_lists_no_file_of_a_recording(spark, sf_dir):
    assert queries.QUERIES["src_9_committed_recordings"](spark, sf_dir).inputFiles() == []


def test_a_recording_longer_than_a_batch_is_one_file(spark, tmp_path):
    n, path = 25_000, str(tmp_path / "out")
    samples = spark.range(2 * n).select((F.col("id") % 2).cast("string").alias("recording_id"), F.expr("id div 2").alias("seq"), *[F.col("id").cast("double").alias(c) for c in sinks.RECORDING_COLUMNS])
    side = spark.createDataFrame([("1", {"side": "left"})], "recording_id string, metadata map<string,string>")
    sinks.write_recordings_once(samples, side, path)
    assert below(path) == ["0.csv", "1.csv", "1_metadata.json"]
    back = sinks.read_recordings(spark, path)
    assert back.count() == 2 * n == back.filter("raw = 2 * seq + recording_id and abs(time_s * 1000 - raw) < 1e-6").dropDuplicates(["recording_id", "seq"]).count()
    assert [r.recording_id for r in sinks.read_sidecars(spark, path).collect()] == ["1"]


def test_reading_back_is_strict_and_nothing_committed_is_empty(spark, tmp_path):
    samples, meta = recordings(spark, 1)
    sinks.write_recordings_once(samples.withColumn("emg_value", F.when(F.col("seq") == 7, "seven").otherwise(F.col("emg_value"))), meta, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sinks.read_recordings(spark, str(tmp_path / "bad")).collect()
    sinks.write_recordings_once(samples.limit(0), meta.limit(0), str(tmp_path / "none"))
    assert sinks.read_recordings(spark, str(tmp_path / "none")).count() == sinks.read_sidecars(spark, str(tmp_path / "none")).count() == 0


def test_an_existing_path_is_refused_and_left_alone(spark, tmp_path):
    samples, meta = recordings(spark, 1)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "mine").write_text("x")
    with pytest.raises(Exception, match="exists"):
        sinks.write_recordings_once(samples, meta, str(tmp_path / "out"))
    assert below(tmp_path) == ["mine"] and os.listdir(tmp_path) == ["out"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    samples, meta = recordings(spark)
    bad = samples.withColumn("time_ms", F.when((F.col("recording_id") == "r1") & (F.col("seq") == 30), F.raise_error(F.lit("torn"))).otherwise(F.col("time_ms")).cast("double"))
    with pytest.raises(Exception, match="torn"):
        sinks.write_recordings_once(bad, meta, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_a_killed_attempt_is_not_committed(spark, tmp_path):
    """What an attempt that never ended has left beside those that did is not moved."""
    writer = sinks._TextWriter(str(tmp_path / "out"), spark.range(1).schema, False)
    killed = f"{writer.staging}/attempts/1-dead"
    os.mkdir(killed)
    open(f"{killed}/rows.csv", "w").write("id\n9")
    done = f"{writer.staging}/attempts/0-whole"
    os.mkdir(done)
    open(f"{done}/rows.csv", "w").write("id\n1\n")
    writer.commit([sinks._Part(0, done, 1)])
    assert [r.id for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "*")).collect()] == ["1"]
    assert os.listdir(tmp_path) == ["out"]


def test_an_attempt_that_outlives_its_job_leaves_nothing(spark, tmp_path):
    writer = sinks._TextWriter(str(tmp_path / "out"), spark.range(1).schema, False)
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([Row(id=1)]))
    assert os.listdir(tmp_path) == []


def test_candidates_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(5).select(*[(F.col("id") if c == "session_id" else F.lit(None).cast("string")).alias(c) for c in sessions.CANDIDATE_COLUMNS])
    sessions.write_candidates(rows, path)
    assert sorted(r.session_id for r in sessions.read_candidates(spark, path).collect()) == list("01234")
    bad = rows.withColumn("side", F.raise_error(F.lit("torn")).cast("string"))
    with pytest.raises(Exception, match="torn"):
        sessions.write_candidates(bad, path)
    assert sessions.read_candidates(spark, path).count() == 5 and os.listdir(tmp_path) == ["c"]
    sessions.write_candidates(rows.limit(0), path)
    assert sessions.read_candidates(spark, path).columns == list(sessions.CANDIDATE_COLUMNS) and sessions.read_candidates(spark, path).count() == 0


LINES = "recording_id string, seq long, host_time_ms long, line string"


def test_lines_are_appended_and_their_clock_goes_on_between_batches(spark, tmp_path):
    top = 2**32
    device = [top - 30, top - 10, None, 5, 3, 40, top - 100, 20, top - 5, 1]
    rows = [("a", i, 1000 + 10 * i, f"{t},{i}.5" if t is not None else "noise,x") for i, t in enumerate(device)]
    rows += [("b", i, 500 + i, f"{i}") for i in range(4)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a, b in ((0, 2), (2, 3), (3, 8), (8, 10)):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], LINES).write.mode("append").parquet(source)
        q = recorder.append_recordings(spark.readStream.schema(LINES).parquet(source), out, str(tmp_path / "cp"), phase="rest")
        assert q.awaitTermination(60) and q.exception() is None
    got = spark.read.parquet(f"{out}/rows")
    lines = signals.parse_lines(spark.createDataFrame(rows, LINES))
    want = {(r.recording_id, r.seq): r.device_time_ms for r in signals.unwrap_clock(lines).collect() if r.value is not None}
    assert {(r.recording_id, r.seq): r.device_time_ms for r in got.collect()} == want and len(want) == 13
    assert want["a", 3] == top + 5 and want["a", 4] is None
    assert [r.time_ms for r in got.filter("recording_id = 'a'").orderBy("seq").collect()] == [0, 10, 30, 40, 50, 60, 70, 80, 90]
    assert {r.phase for r in got.collect()} == {"rest"}
    assert [tuple(r) for r in recorder.malformed_lines(spark, out).collect()] == [("a", 1)]


def test_json_at_every_depth(spark):
    rows = spark.sql("select double('nan') b, named_struct('z', double('inf'), 'a', array(1.5d, double('-inf'))) a, map('k2', double('nan'), 'k1', 2d) c, cast(null as struct<q: double>) d, array(named_struct('y', 1, 'x', double('nan'))) e")
    assert sessions.as_json(rows).first().json == '{"a":{"a":[1.5,null],"z":null},"b":null,"c":{"k1":2.0,"k2":null},"d":null,"e":[{"x":null,"y":1}]}'
