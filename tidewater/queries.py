"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import calibration, compare, detect, hybrid, matching, metrics, quality, smoothing
from .plans import analysis, report
from .sources import catalog, sessions, signals, sinks
from .streaming import lifecycle, recorder, timing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_S = """WITH RECURSIVE s0 AS (
  SELECT user_id AS recording_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS seq, value AS raw, event_type FROM events
), s1 AS (SELECT *, seq * 0.1::DOUBLE AS time_s, count(*) OVER (PARTITION BY recording_id) AS n FROM s0)
"""
_SMOOTH = _S + """, s AS (
  SELECT recording_id, seq, time_s, raw, n, round(CASE WHEN n >= 14 THEN avg(raw) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)
    ELSE avg(raw) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN (n // 2) PRECEDING AND (n // 2) FOLLOWING) END, 9) AS smooth FROM s1
)
"""
_SMOOTH_PLAIN = _S + """, s AS (
  SELECT recording_id, seq, time_s, raw, n, round(avg(raw) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 9) AS smooth FROM s1
)
"""
_LIMITS = _SMOOTH_PLAIN + """, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY smooth) AS u FROM s),
lo AS (SELECT recording_id, round(avg(smooth) FILTER (u <= greatest(1, floor(n * 10 / 100.0))), 9) AS baseline, max(smooth) AS max_signal, count(*) AS reference_count FROM r GROUP BY ALL),
lim AS (SELECT recording_id, baseline, max_signal, round(max_signal - baseline, 9) AS signal_range, round(baseline + 0.18::DOUBLE * (max_signal - baseline), 9) AS start_threshold,
  round(baseline + 0.085::DOUBLE * (max_signal - baseline), 9) AS end_threshold, reference_count FROM lo)
"""
_REPS = _LIMITS + """, e0 AS (
  SELECT s.*, l.start_threshold AS st, l.end_threshold AS en, lag(smooth) OVER w AS b, lead(seq) OVER w IS NULL AS last FROM s JOIN lim l USING (recording_id) WINDOW w AS (PARTITION BY recording_id ORDER BY seq)
), e1 AS (SELECT *, CASE WHEN b IS NULL THEN smooth >= st ELSE b <= st AND smooth > st END AS up, smooth <= en AS low FROM e0),
e AS (SELECT recording_id, time_s, up, low AND (b IS NULL OR b > en OR up) AS down, last, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS k FROM e1
  WHERE up OR last OR low AND (b IS NULL OR b > en)),
f AS (
  SELECT recording_id, 0::BIGINT AS k, false AS inside, NULL::DOUBLE AS start, NULL::DOUBLE AS until, NULL::DOUBLE AS rep_start, NULL::DOUBLE AS rep_end FROM (SELECT DISTINCT recording_id FROM e)
  UNION ALL
  SELECT y.recording_id, y.k, y.ins AND NOT y.ends, y.st, CASE WHEN y.good THEN y.time_s + 0.25::DOUBLE ELSE y.until END, CASE WHEN y.good THEN y.st END, CASE WHEN y.good THEN y.time_s END
  FROM (SELECT x.*, x.ins AND (x.down OR x.last) AS ends, x.ins AND (x.down OR x.last) AND round(x.time_s - x.st, 6) >= 0.35::DOUBLE AS good FROM (
    SELECT e.*, f.until, f.inside OR (e.up AND (f.until IS NULL OR round(e.time_s, 6) >= round(f.until, 6))) AS ins,
      CASE WHEN NOT f.inside AND e.up AND (f.until IS NULL OR round(e.time_s, 6) >= round(f.until, 6)) THEN e.time_s ELSE f.start END AS st
    FROM f JOIN e ON e.recording_id = f.recording_id AND e.k = f.k + 1) x) y
), reps0 AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY k) AS rep_no, rep_start AS start_time, rep_end AS end_time FROM f WHERE rep_start IS NOT NULL),
ev AS (
  SELECT p.recording_id, p.rep_no, p.start_time, p.end_time, round(p.end_time - p.start_time, 9) AS duration, round(max(s.smooth - l.start_threshold), 9) AS peak_excess,
    round(sum(greatest(0, s.smooth - l.start_threshold)) * CASE WHEN count(*) > 1 THEN (p.end_time - p.start_time) / (count(*) - 1) ELSE 0 END, 9) AS area
  FROM reps0 p JOIN s ON s.recording_id = p.recording_id AND s.time_s BETWEEN p.start_time AND p.end_time JOIN lim l ON l.recording_id = p.recording_id GROUP BY p.recording_id, p.rep_no, p.start_time, p.end_time
), med AS (SELECT recording_id, median(duration) AS md, median(area) AS ma, median(peak_excess) AS mp FROM ev WHERE rep_no > 1 GROUP BY ALL),
reps AS (
  SELECT ev.recording_id, row_number() OVER (PARTITION BY ev.recording_id ORDER BY rep_no)::BIGINT AS rep_no, start_time, end_time FROM ev LEFT JOIN med USING (recording_id)
  WHERE rep_no > 1 OR NOT coalesce(md > 0 AND ma > 0 AND mp > 0 AND duration < md * 0.55::DOUBLE AND area < ma * 0.35::DOUBLE AND peak_excess < mp * 0.55::DOUBLE, false)
), inr AS (
  SELECT p.*, s.seq, s.time_s, s.raw, s.time_s - lag(s.time_s) OVER w AS dt, (s.raw + lag(s.raw) OVER w) / 2 AS pr FROM reps p JOIN s1 s ON s.recording_id = p.recording_id AND s.time_s BETWEEN p.start_time AND p.end_time
  WINDOW w AS (PARTITION BY p.recording_id, p.rep_no ORDER BY s.seq)
), rm AS (
  SELECT recording_id, rep_no, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(end_time - start_time, 6) AS duration, round(round(sum(raw), 6) / count(raw), 6) AS mean_value, round(max(raw), 6) AS peak_value,
    round(arg_min(time_s, {'a': -raw, 'b': seq}), 6) AS peak_time, round(CASE WHEN count(*) = 1 THEN round(sum(raw), 6) / count(raw) * (end_time - start_time) ELSE coalesce(sum(pr * dt) FILTER (dt > 0), 0) END, 6) AS integral,
    round(integral / (end_time - start_time), 6) AS mean_activation, count(*)::BIGINT AS n_samples
  FROM inr GROUP BY recording_id, rep_no, inr.start_time, inr.end_time
)
"""
_SUMMARY = _REPS + """, h AS (SELECT *, rep_no <= count(*) OVER (PARTITION BY recording_id) // 2 AS first FROM rm),
g AS (SELECT recording_id, count(*) AS rep_count, arg_min(rep_no, {'a': -peak_value, 'b': rep_no}) AS strongest_rep, arg_max(end_time, rep_no) - arg_min(start_time, rep_no) AS set_duration, round(sum(duration), 6) / count(*) AS avg_duration, round(sum(mean_value), 6) / count(*) AS avg_value,
  round(sum(peak_value), 6) / count(*) AS avg_peak, max(peak_value) AS highest_peak, round(sum(peak_value) FILTER (first), 6) / nullif(count(*) FILTER (first), 0) AS a, round(sum(peak_value) FILTER (NOT first), 6) / nullif(count(*) FILTER (NOT first), 0) AS b FROM h GROUP BY recording_id),
sm AS (SELECT i.recording_id, coalesce(rep_count, 0)::BIGINT AS rep_count, coalesce(strongest_rep, 0)::BIGINT AS strongest_rep, round(coalesce(set_duration, 0), 6) AS set_duration, round(coalesce(avg_duration, 0), 6) AS avg_duration, round(coalesce(avg_value, 0), 6) AS avg_value,
  round(coalesce(avg_peak, 0), 6) AS avg_peak, round(coalesce(highest_peak, 0), 6) AS highest_peak, round(coalesce(CASE WHEN a > 0 THEN (a - b) / a * 100 ELSE 0 END, 0), 6) AS peak_drop, coalesce(CASE WHEN a > 0 THEN (a - b) / a * 100 ELSE 0 END, 0) >= 15 AS possible_fatigue
  FROM (SELECT DISTINCT recording_id FROM s1) i LEFT JOIN g USING (recording_id))
"""
_RECS = """WITH rc0 AS (SELECT user_id AS recording_id, max(ts) AS mtime FROM events GROUP BY 1),
rc AS (SELECT recording_id, mtime, (recording_id % 10)::BIGINT AS participant_id, CASE WHEN recording_id % 7 = 0 THEN '' WHEN recording_id % 2 = 0 THEN 'right' ELSE 'Left ' END AS side,
  CASE WHEN recording_id % 3 = 0 THEN 'biceps' WHEN recording_id % 8 = 1 THEN 'Triceps' ELSE 'triceps' END AS muscle, CASE WHEN recording_id // 10 % 4 = 3 THEN '' ELSE (recording_id // 10 % 4)::VARCHAR END AS weight, 'curl' AS exercise, (recording_id % 4)::VARCHAR AS setup_id,
  CASE WHEN recording_id % 10 = 0 THEN 'calibration' ELSE 'workout_set' END AS test_type, 'r' || recording_id || '.csv' AS csv_filename,
  CASE WHEN recording_id % 17 = 4 THEN 'r' || (recording_id // 17 * 10) || '.csv' WHEN recording_id % 19 = 5 THEN 'r1.csv' ELSE '' END AS calibration_csv, CASE WHEN recording_id % 23 = 6 THEN 'Stale since May' END AS calibration_status FROM rc0)
"""


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata made up for every user's recording."""
    r = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("recording_id")).agg(F.max("ts").alias("mtime"))
    i = F.col("recording_id")
    return r.withColumns({
        "participant_id": i % 10, "side": F.when(i % 7 == 0, "").when(i % 2 == 0, "right").otherwise("Left "), "muscle": F.when(i % 3 == 0, "biceps").when(i % 8 == 1, "Triceps").otherwise("triceps"), "weight": F.when(F.expr("recording_id div 10 % 4") == 3, "").otherwise(F.expr("recording_id div 10 % 4").cast("string")),
        "exercise": F.lit("curl"), "setup_id": (i % 4).cast("string"), "test_type": F.when(i % 10 == 0, "calibration").otherwise("workout_set"), "csv_filename": F.concat(F.lit("r"), i, F.lit(".csv")),
        "calibration_csv": F.when(i % 17 == 4, F.concat(F.lit("r"), F.expr("recording_id div 17 * 10"), F.lit(".csv"))).when(i % 19 == 5, "r1.csv").otherwise(""), "calibration_status": F.when(i % 23 == 6, "Stale since May")})


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.event_recordings(spark, sf_dir)


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.centered_average(_ev(spark, sf_dir))


@query(_S + "SELECT recording_id, seq, time_s, raw FROM s1")
def src_1_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ev(spark, sf_dir)


@query("""SELECT event_id, CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0 THEN (event_id * 10)::BIGINT END AS device_time_ms, CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events""")
def src_5_serial_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    line = F.when(i % 17 == 0, "not-a-number").when(i % 19 == 0, F.col("value").cast("string")).when(i % 23 == 0, F.concat(F.lit("late, "), F.col("value").cast("string"))).when(i % 29 == 0, F.concat(F.lit(", "), (i * 10).cast("string"), F.lit(".7,, "), F.col("value").cast("string"), F.lit(" ,"))).otherwise(F.concat_ws(",", (i * 10).cast("string"), F.col("value").cast("string")))
    return signals.parse_lines(e.select("event_id", line.alias("line"))).select("event_id", "device_time_ms", "value")


@query(_S + "SELECT recording_id, seq, CASE WHEN seq % 7 <> 3 THEN 2147483648 + seq * 900000000 END AS device_time_ms FROM s1")
def src_6_clock_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = (F.col("seq") % 7 == 3).cast("long")  # a reading that comes a little before the one ahead of it
    w = _ev(spark, sf_dir).withColumn("device_time_ms", F.greatest(F.lit(0), (F.lit(2147483648) + (F.col("seq") - late) * 900000000) % signals.CLOCK_PERIOD - 5 * late))
    return signals.unwrap_clock(w).select("recording_id", "seq", "device_time_ms")


def _new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session shares, or on one machine in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(_S + "SELECT recording_id::VARCHAR AS recording_id, seq, round(time_s, 6) AS time_s, raw, CASE WHEN recording_id % 5 <> 2 THEN CASE WHEN recording_id % 2 = 0 THEN 'left' ELSE 'right' END END AS side FROM s1")
def src_9_committed_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording as a file with its sidecar, written in one commit and read back."""
    path, ev = _new_folder(spark, "recordings"), _ev(spark, sf_dir)
    ms = (F.col("time_s") * 1000).alias("time_ms")
    samples = ev.select("recording_id", "seq", ms, (F.col("seq") * 100 + 7).alias("host_time_ms"), F.when(F.col("seq") % 3 > 0, F.col("seq") * 100).alias("device_time_ms"), F.lit(0.5).alias("host_elapsed_ms"), F.lit(None).alias("timing_drift_ms"), F.col("raw").alias("emg_value"), F.concat_ws(",", "seq", "raw").alias("raw_serial_sample"))
    side = F.when(F.col("recording_id") % 2 == 0, "left").otherwise("right")
    sides = ev.select("recording_id").distinct().filter("recording_id % 5 != 2").select("recording_id", F.create_map(F.lit("side"), side).alias("metadata"))
    sinks.write_recordings_once(samples, sides, path)
    back = sinks.read_recordings(spark, path)
    return back.join(sinks.read_sidecars(spark, path), "recording_id", "left").select("recording_id", "seq", F.round("time_s", 6).alias("time_s"), "raw", F.col("metadata.side").alias("side"))


@query(_S + """SELECT recording_id, seq, (seq * 10)::BIGINT AS time_ms, CASE WHEN seq % 7 <> 3 THEN 2147483648 + seq * 900000000 END AS device_time_ms, raw AS value, count(*) FILTER (seq % 7 = 5) OVER (PARTITION BY recording_id) AS malformed FROM s1 QUALIFY seq % 7 <> 5""")
def src_10_appended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's lines as a stream: what its sink has appended, and how many lines of the recording it could not read."""
    lines, out = _new_folder(spark, "lines"), _new_folder(spark, "appended")
    late = (F.col("seq") % 7 == 3).cast("long")
    device = F.greatest(F.lit(0), (F.lit(2147483648) + (F.col("seq") - late) * 900000000) % signals.CLOCK_PERIOD - 5 * late)
    line = F.when(F.col("seq") % 7 == 5, "lost").otherwise(F.concat_ws(",", device, "raw"))
    _ev(spark, sf_dir).select("recording_id", "seq", (F.col("seq") * 10 + 3).alias("host_time_ms"), line.alias("line")).write.parquet(lines)
    stream = spark.readStream.schema(spark.read.parquet(lines).schema).parquet(lines)
    recorder.append_recordings(stream, out, _new_folder(spark, "appending")).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").join(recorder.malformed_lines(spark, out), "recording_id", "left")
    return rows.select("recording_id", "seq", "time_ms", "device_time_ms", "value", F.coalesce("malformed", F.lit(0).cast("long")).alias("malformed"))


@query(_SMOOTH_PLAIN + "SELECT recording_id, seq, round(smooth, 6) AS smooth FROM s")
def win_1_centered_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smooth(spark, sf_dir).select("recording_id", "seq", F.round("smooth", 6).alias("smooth"))


@query(_S + "SELECT recording_id, seq, round(avg(raw) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 6) AS trailing FROM s1")
def win_2_trailing_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.trailing_average(_ev(spark, sf_dir)).select("recording_id", "seq", F.round("trailing", 6).alias("trailing"))


@query(_S + """, w AS (SELECT recording_id, seq, list(raw) OVER q AS v, max(raw) OVER q AS hi, count(*) OVER q AS k FROM s1 WINDOW q AS (PARTITION BY recording_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN k < 30 THEN list_avg(v) ELSE list_avg(list_sort(v)[1:greatest(1, k // 10)]) END AS base FROM w)
SELECT recording_id, seq, round(base + CASE WHEN k < 30 THEN 18 ELSE greatest(18, 0.12::DOUBLE * (hi - base)) END, 7) AS enter, round(base + CASE WHEN k < 30 THEN 12 ELSE greatest(12, 0.075::DOUBLE * (hi - base)) END, 7) AS leave FROM b""")
def win_3_expanding_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expanding_baseline(_ev(spark, sf_dir)).select("recording_id", "seq", "enter", "leave")


@query(_LIMITS + """, x AS (SELECT s.recording_id, s.seq, s.smooth, lag(s.smooth) OVER (PARTITION BY s.recording_id ORDER BY s.seq) AS b, l.start_threshold AS t FROM s JOIN lim l USING (recording_id))
SELECT recording_id, seq, round(smooth, 6) AS smooth FROM x WHERE b <= t AND smooth > t""")
def win_4_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _smooth(spark, sf_dir)
    return smoothing.crossings(s, smoothing.thresholds(s)).select("recording_id", "seq", F.round("smooth", 6).alias("smooth"))


_MINIMA = _SMOOTH_PLAIN + """, m0 AS (SELECT *, lag(smooth) OVER w AS b, lead(smooth) OVER w AS a FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY seq)), m AS (SELECT * FROM m0 WHERE smooth <= b AND smooth < a)
"""


@query(_MINIMA + "SELECT recording_id, seq, round(smooth, 6) AS smooth FROM m")
def win_5_local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.local_minima(_smooth(spark, sf_dir)).select("recording_id", "seq", F.round("smooth", 6).alias("smooth"))


@query(_MINIMA + """, c0 AS (SELECT *, CASE WHEN round(time_s - lag(time_s) OVER (PARTITION BY recording_id ORDER BY seq), 6) <= 0.30::DOUBLE THEN 0 ELSE 1 END AS f FROM m),
c AS (SELECT *, sum(f) OVER (PARTITION BY recording_id ORDER BY seq) AS cluster FROM c0)
SELECT recording_id, cluster::BIGINT AS cluster, arg_min(seq, {'a': smooth, 'b': seq}) AS seq, round(min(smooth), 6) AS smooth, count(*)::BIGINT AS members FROM c GROUP BY recording_id, cluster""")
def win_6_valley_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = smoothing.valley_clusters(smoothing.local_minima(_smooth(spark, sf_dir)))
    return v.withColumn("smooth", F.round("smooth", 6))


@query(_LIMITS + """, h AS (SELECT s.recording_id, s.seq, s.time_s, s.seq - row_number() OVER (PARTITION BY s.recording_id ORDER BY s.seq) AS i FROM s JOIN lim l USING (recording_id) WHERE s.smooth > l.start_threshold)
SELECT recording_id, round(max(d), 6) AS longest_run FROM (SELECT recording_id, max(time_s) - min(time_s) AS d FROM h GROUP BY recording_id, i) GROUP BY recording_id""")
def win_7_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _smooth(spark, sf_dir)
    high = s.join(smoothing.thresholds(s).select("recording_id", "start_threshold"), "recording_id").filter("smooth > start_threshold")
    return smoothing.longest_run(high, ("recording_id",)).withColumn("longest_run", F.round("longest_run", 6))


@query(_S + """, c AS (SELECT recording_id, seq, CASE WHEN raw >= 60 THEN 1 WHEN raw <= 20 THEN 0 END AS x FROM s1)
SELECT recording_id, seq, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) = 1 AS active FROM c""")
def win_12_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.hysteresis(_ev(spark, sf_dir), F.lit(60.0), F.lit(20.0)).select("recording_id", "seq", "active")


@query(_LIMITS + "SELECT recording_id, round(baseline, 6) AS baseline, round(max_signal, 6) AS max_signal, round(start_threshold, 6) AS start_threshold, round(end_threshold, 6) AS end_threshold, reference_count::BIGINT AS reference_count FROM lim")
def prj_3_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = smoothing.thresholds(_smooth(spark, sf_dir))
    return t.select("recording_id", *[F.round(c, 6).alias(c) for c in ("baseline", "max_signal", "start_threshold", "end_threshold")], "reference_count")


@query(_LIMITS + """SELECT s.recording_id, coalesce(max(CASE WHEN l.signal_range > 0 AND s.smooth > l.end_threshold THEN s.seq END), max(s.seq))::BIGINT AS last_seq FROM s JOIN lim l USING (recording_id) GROUP BY s.recording_id""")
def agg_4_active_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.active_prefix(_smooth(spark, sf_dir)).groupBy("recording_id").agg(F.max("seq").alias("last_seq"))


_CAL = _S + """, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY raw) AS u, row_number() OVER (PARTITION BY recording_id ORDER BY raw DESC) AS d FROM s1),
cal AS (SELECT recording_id, round(avg(raw) FILTER (u <= greatest(1, floor(n * 10 / 100.0))), 9) AS baseline, round(avg(raw) FILTER (d <= greatest(1, floor(n * 10 / 100.0))), 9) AS max_flex FROM r GROUP BY ALL)
"""


@query(_CAL + "SELECT recording_id, round(baseline, 6) AS baseline, round(max_flex, 6) AS max_flex, round(max_flex - baseline, 6) AS signal_range, max_flex - baseline >= 1 AS usable FROM cal")
def agg_2_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calibration.tail_calibration(_ev(spark, sf_dir))
    return c.select("recording_id", *[F.round(x, 6).alias(x) for x in ("baseline", "max_flex", "signal_range")], "usable")


@query(_CAL + """, a AS (SELECT s1.recording_id, seq, CASE WHEN max_flex - baseline >= 1 THEN greatest(0, (raw - baseline) / (max_flex - baseline) * 100) ELSE 0 END AS activation FROM s1 JOIN cal USING (recording_id))
SELECT recording_id, seq, round(activation, 6) AS activation FROM a""")
def prj_2_normalised_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    return calibration.normalise(ev, calibration.tail_calibration(ev)).select("recording_id", "seq", "activation")


@query(_S + """, x AS (SELECT *, max(raw) OVER (PARTITION BY recording_id) AS hi, min(raw) OVER (PARTITION BY recording_id) AS lo FROM s1)
SELECT recording_id, round(avg((raw >= hi - greatest(2, (hi - lo) * 0.01::DOUBLE))::INT) * 100, 6) AS near_max_percent FROM x GROUP BY ALL""")
def agg_17_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.saturation(_ev(spark, sf_dir)).select("recording_id", "near_max_percent")


@query(_S + """, x AS (SELECT *, max(raw) OVER p AS hi, min(raw) OVER p AS lo, (time_s - lag(time_s) OVER (PARTITION BY recording_id ORDER BY seq)) * 1000 AS g FROM s1 WINDOW p AS (PARTITION BY recording_id))
SELECT recording_id, count(*)::BIGINT AS n, min(raw) AS lowest, max(raw) AS highest, round(avg(raw), 6) AS mean, round(count(*) / (max(time_s) - min(time_s)), 6) AS rate, round(max(g), 6) AS largest_gap_ms, round(avg(g), 6) AS mean_gap_ms,
 round(avg((raw = hi OR raw = lo)::INT), 6) AS pinned, round(avg((raw > (lo + hi) / 2)::INT) * 100, 6) AS percent_above_middle FROM x GROUP BY recording_id""")
def agg_18_raw_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.raw_statistics(_ev(spark, sf_dir)).drop("warnings")


@query(_REPS + "SELECT recording_id, rep_no, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM reps0")
def seg_1_threshold_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _smooth(spark, sf_dir)
    r = detect.threshold_reps(s, smoothing.thresholds(s))
    return r.select("recording_id", "rep_no", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@query(_REPS + "SELECT recording_id, rep_no, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM reps")
def seg_2_without_transient(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _smooth(spark, sf_dir)
    r = detect.detect(s, smoothing.thresholds(s))
    return r.select("recording_id", "rep_no", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@query(_REPS + "SELECT * FROM rm")
def agg_6_rep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.repetitions(_ev(spark, sf_dir))


@query(_SUMMARY + "SELECT * FROM sm")
def agg_7_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.summaries(_ev(spark, sf_dir))


#: Calibrations of some recordings: three neighbours share that of the last of them; every ninth has none, every eleventh is said to be unusable.
_BORROWED = """, cl0 AS (SELECT recording_id // 3 AS g, max(recording_id) AS lender FROM cal GROUP BY 1),
cl AS (SELECT a.recording_id, b.baseline, b.max_flex, round(b.max_flex - b.baseline, 9) AS signal_range, CASE WHEN a.recording_id % 11 = 3 THEN false WHEN a.recording_id % 7 <> 1 THEN true END AS usable, 'r' || b.recording_id || '.csv' AS source_csv
  FROM cal a JOIN cl0 ON g = a.recording_id // 3 JOIN cal b ON b.recording_id = lender WHERE a.recording_id % 9 <> 5),
us AS (SELECT * FROM cl WHERE coalesce(usable, true) AND signal_range >= 1),
act AS (SELECT s.recording_id, s.seq, s.time_s, s.raw, round(greatest(0, (s.raw - u.baseline) / u.signal_range * 100), 6) AS activation FROM s1 s JOIN us u USING (recording_id))
"""
_CAL_TAIL = """, cr AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY raw) AS u, row_number() OVER (PARTITION BY recording_id ORDER BY raw DESC) AS d FROM s1),
cal AS (SELECT recording_id, round(avg(raw) FILTER (u <= greatest(1, floor(n * 10 / 100.0))), 9) AS baseline, round(avg(raw) FILTER (d <= greatest(1, floor(n * 10 / 100.0))), 9) AS max_flex FROM cr GROUP BY ALL)
"""
_SETS = _REPS + _CAL_TAIL + _BORROWED + """, nx AS (
  SELECT p.recording_id, p.rep_no, p.start_time, p.end_time, a.seq, a.activation AS x, a.time_s - lag(a.time_s) OVER w AS dt, (a.activation + lag(a.activation) OVER w) / 2 AS pr FROM reps p JOIN act a ON a.recording_id = p.recording_id AND a.time_s BETWEEN p.start_time AND p.end_time
  WINDOW w AS (PARTITION BY p.recording_id, p.rep_no ORDER BY a.seq)
), ny AS (
  SELECT recording_id, rep_no, max(x) AS peak, round(CASE WHEN count(*) = 1 THEN max(x) * (end_time - start_time) ELSE coalesce(sum(pr * dt) FILTER (dt > 0), 0) END, 6) AS integral, end_time - start_time AS d FROM nx GROUP BY recording_id, rep_no, start_time, end_time
), rv AS (SELECT recording_id, rep_no, '' AS k, mean_activation AS v, peak_value AS peak, integral, duration FROM rm UNION ALL SELECT recording_id, rep_no, 'n', round(integral / d, 6), peak, integral, round(d, 6) FROM ny
), hb AS (SELECT *, rep_no <= greatest(1, count(*) OVER (PARTITION BY recording_id, k) // 2) AS early FROM rv
), sg AS (
  SELECT recording_id, k, count(*) AS n, round(sum(duration), 6) AS active, round(sum(integral), 6) AS integral, median(v) AS med, max(peak) AS peak, round(sum(v) FILTER (early), 6) / count(*) FILTER (early) AS e, round(sum(v) FILTER (NOT early), 6) / nullif(count(*) FILTER (NOT early), 0) AS l,
    (count(*) * round(sum(rep_no * v), 6) - sum(rep_no) * round(sum(v), 6)) / nullif(count(*) * sum(rep_no * rep_no) - sum(rep_no) * sum(rep_no), 0) AS slope, round(sum(duration), 6) / count(*) AS md, median(duration) AS dm, stddev_pop(duration) AS dd FROM hb GROUP BY recording_id, k
), ends AS (SELECT recording_id, max(end_time) - min(start_time) AS span FROM rm GROUP BY 1
), ex AS (SELECT recording_id, min(raw) AS raw_min, max(raw) AS raw_max, round(max(time_s) - min(time_s), 6) AS recording_duration FROM s1 GROUP BY 1
), sets AS (
  SELECT x.recording_id, coalesce(a.n, 0)::BIGINT AS rep_count, raw_min, raw_max, recording_duration, u.recording_id IS NOT NULL AS calibration_usable, round(coalesce(a.active, 0), 6) AS active_time, round(coalesce(a.md, 0), 6) AS mean_duration, round(coalesce(a.dm, 0), 6) AS median_duration,
    round(coalesce(a.dd, 0), 6) AS duration_deviation, round(coalesce(a.dd / nullif(a.md, 0) * 100, 0), 6) AS duration_variation, round(coalesce(a.med, 0), 6) AS median_activation, round(coalesce(a.peak, 0), 6) AS peak_activation, round(coalesce(ends.span, recording_duration), 6) AS set_duration,
    round(coalesce(a.integral, 0), 6) AS total_integral, round(coalesce(a.integral / nullif(a.active, 0), 0), 6) AS mean_activation, round(a.e, 6) AS early_mean, round(a.l, 6) AS late_mean, round(a.l - a.e, 6) AS change, round(a.slope, 6) AS slope,
    CASE WHEN u.recording_id IS NOT NULL THEN round(b.integral / nullif(b.active, 0), 6) END AS norm_mean_activation, CASE WHEN u.recording_id IS NOT NULL THEN round(coalesce(b.med, 0), 6) END AS norm_median_activation, CASE WHEN u.recording_id IS NOT NULL THEN round(coalesce(b.integral, 0), 6) END AS norm_integral,
    round(b.peak, 6) AS norm_peak_activation, round(b.e, 6) AS norm_early_mean, round(b.l, 6) AS norm_late_mean, round(b.l - b.e, 6) AS norm_change, round(b.slope, 6) AS norm_slope
  FROM ex x LEFT JOIN us u USING (recording_id) LEFT JOIN ends USING (recording_id) LEFT JOIN sg a ON a.recording_id = x.recording_id AND a.k = '' LEFT JOIN sg b ON b.recording_id = x.recording_id AND b.k = 'n'
)
"""


def _borrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration for most recordings, that of the last of three neighbours."""
    own, r = calibration.tail_calibration(_ev(spark, sf_dir)), F.col("recording_id")
    group = F.expr("recording_id div 3").alias("g")
    of = F.struct("baseline", "max_flex", "signal_range", F.concat(F.lit("r"), r, F.lit(".csv")).alias("source_csv"))
    lent = own.groupBy(group).agg(F.max_by(of, r).alias("c"))
    said = F.when(r % 11 == 3, False).when(r % 7 != 1, True)
    return own.select(r, group).join(lent, "g").select(r, "c.*", said.alias("usable")).filter(r % 9 != 5)


def _fours(df: DataFrame) -> DataFrame:
    """Floating-point columns to four decimals, a little above what they are, for engines round halves differently."""
    return df.select(*[F.round(F.col(c) + 1e-7, 4).alias(c) if t == "double" else c for c, t in df.dtypes])


def _rounded(columns: str, table: str) -> str:
    return "SELECT " + ", ".join(c if c in ("recording_id", "rep_count", "calibration_usable") else f"round({c} + 1e-7, 4) AS {c}" for c in columns.split()) + f" FROM {table}"


_SET_COLUMNS = "recording_id rep_count raw_min raw_max recording_duration calibration_usable active_time mean_duration median_duration duration_deviation duration_variation median_activation peak_activation set_duration total_integral mean_activation early_mean late_mean change slope norm_mean_activation norm_median_activation norm_integral norm_peak_activation norm_early_mean norm_late_mean norm_change norm_slope"


@query(_SETS + _rounded(_SET_COLUMNS, "sets"))
def agg_10_set_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fours(analysis.set_analysis(_ev(spark, sf_dir), _borrowed(spark, sf_dir)))


_QUALITY = """, hh AS (SELECT a.recording_id, a.activation, count(p.rep_no) AS k FROM act a LEFT JOIN reps p ON p.recording_id = a.recording_id AND a.time_s BETWEEN p.start_time AND p.end_time GROUP BY a.recording_id, a.seq, a.activation),
hu AS (SELECT recording_id, max(activation) AS top, round(avg((activation > 100)::INT), 6) AS f, round(coalesce(sum((activation > 100)::INT * k) / nullif(sum(k), 0), 0), 6) AS g FROM hh GROUP BY 1),
hq AS (SELECT x.recording_id, top, f, g, c.baseline IS NULL AS none, u.recording_id IS NULL AS bad, greatest(f, g) AS o, top / 100 AS q, c.source_csv, round(c.baseline, 6) AS b, round(c.signal_range, 6) AS r FROM ex x LEFT JOIN cl c USING (recording_id) LEFT JOIN us u USING (recording_id) LEFT JOIN hu USING (recording_id)),
quality AS (
  SELECT recording_id, top AS max_activation, coalesce(f, 0) AS over_fraction, coalesce(g, 0) AS rep_over_fraction, CASE WHEN none THEN 'missing' WHEN bad THEN 'unusable' WHEN q >= 3 OR o >= 0.5 THEN 'severe' WHEN q >= 2 OR o >= 0.25 THEN 'moderate' WHEN q > 1 THEN 'mild' ELSE 'ok' END AS level,
    NOT (none OR bad OR q >= 3 OR o >= 0.5) AS cross_session,
    CASE WHEN none THEN 'missing calibration' WHEN bad THEN 'calibration range too small' ELSE concat_ws('; ', CASE WHEN q > 1 THEN 'above the reference' END, CASE WHEN q >= 2 OR o >= 0.25 THEN 'moderately above' END, CASE WHEN q >= 3 OR o >= 0.5 THEN 'severely above' END) END AS reasons,
    CASE WHEN NOT none AND NOT bad THEN source_csv || '|' || printf('%.6f', b) || '|' || printf('%.6f', r) END AS signature FROM hq
)
"""


def _signature_text() -> Column:
    part = lambda c: F.format_string("%.6f", F.col(f"signature.{c}"))
    return F.when(F.col("signature").isNotNull(), F.concat_ws("|", F.col("signature.source_csv"), part("baseline"), part("signal_range")))


@query(_SETS + _QUALITY + "SELECT * FROM quality")
def agg_16_calibration_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = analysis.calibration_quality(_ev(spark, sf_dir), _borrowed(spark, sf_dir))
    return q.select("recording_id", "max_activation", "over_fraction", "rep_over_fraction", "level", "cross_session", F.array_join("reasons", "; ").alias("reasons"), _signature_text().alias("signature"))


_CALS = """, c AS (SELECT recording_id AS calibration_id, mtime, lower(trim(muscle)) AS m, lower(trim(side)) AS s, setup_id AS u, csv_filename FROM rc WHERE test_type = 'calibration'),
q AS (SELECT recording_id, lower(trim(muscle)) AS m, lower(trim(side)) AS s, setup_id AS u, calibration_csv AS f FROM rc WHERE NOT coalesce(contains(lower(calibration_status), 'stale') OR contains(lower(calibration_status), 'questionable'), false))
"""


@query(_RECS + _CALS + """, p AS (SELECT q.recording_id, c.calibration_id, row_number() OVER (PARTITION BY q.recording_id ORDER BY c.mtime DESC, c.calibration_id DESC) AS k
FROM q JOIN c ON (q.f = '' OR q.f = c.csv_filename) AND (q.m = '' OR q.s = '' OR (c.u = q.u AND c.m = q.m AND c.s = q.s)))
SELECT recording_id, calibration_id FROM p WHERE k = 1""")
def jn_2_newest_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recordings(spark, sf_dir)
    return calibration.newest_compatible(r, r.filter("test_type = 'calibration'").withColumnRenamed("recording_id", "calibration_id"))


@query(_RECS + _CALS + """, p AS (SELECT q.recording_id, c.calibration_id, row_number() OVER (PARTITION BY q.recording_id ORDER BY c.mtime DESC, c.calibration_id DESC) AS k
FROM q JOIN c ON (q.f = '' OR q.f = c.csv_filename) AND c.u = q.u AND c.m = q.m AND c.s = q.s WHERE q.m <> '' AND q.s <> '')
SELECT recording_id, calibration_id FROM p WHERE k = 1""")
def jn_3_strict_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recordings(spark, sf_dir)
    return calibration.newest_compatible(r, r.filter("test_type = 'calibration'").withColumnRenamed("recording_id", "calibration_id"), strict=True)


_PAIR = """, w AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY mtime DESC, recording_id) AS rk FROM rc WHERE test_type = 'workout_set'),
pp AS (SELECT a.participant_id, a.recording_id AS newer, b.recording_id AS older, a.rk AS ak, b.rk AS bk, trim(a.muscle) = trim(b.muscle) AND trim(a.side) = trim(b.side) AND (trim(a.weight) = '' OR trim(b.weight) = '' OR trim(a.weight) = trim(b.weight)) AS ok
  FROM w a JOIN w b USING (participant_id) WHERE a.rk < b.rk),
pair AS (SELECT participant_id, newer, older, ok AS compatible FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY NOT ok, ak, bk) AS k FROM pp WHERE ok OR (ak = 1 AND bk = 2)) WHERE k = 1)
"""


@query(_RECS + _PAIR + "SELECT * FROM pair")
def jn_4_comparison_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.newest_pair(_recordings(spark, sf_dir).filter("test_type = 'workout_set'"))


@query(_RECS + """, p AS (SELECT a.recording_id, b.recording_id AS previous_id, row_number() OVER (PARTITION BY a.recording_id ORDER BY b.mtime DESC, b.recording_id DESC) AS k FROM rc a LEFT JOIN rc b ON a.recording_id <> b.recording_id AND a.exercise = b.exercise AND lower(trim(a.side)) = lower(trim(b.side)) AND a.weight = b.weight)
SELECT recording_id, previous_id FROM p WHERE k = 1""")
def jn_5_previous_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.previous_compatible(_recordings(spark, sf_dir))


@query(_SUMMARY + _RECS.replace("WITH ", ", ", 1) + _PAIR + """
SELECT newer, older, a.rep_count AS newer_reps, b.rep_count AS older_reps, CASE WHEN a.avg_value > b.avg_value THEN 'Set 1' WHEN b.avg_value > a.avg_value THEN 'Set 2' ELSE 'Tie' END AS higher_activation,
 CASE WHEN a.highest_peak > b.highest_peak THEN 'Set 1' WHEN b.highest_peak > a.highest_peak THEN 'Set 2' ELSE 'Tie' END AS higher_peak,
 CASE WHEN greatest(a.peak_drop, b.peak_drop) <= 5 THEN 'Neither' WHEN a.peak_drop > b.peak_drop THEN 'Set 1' WHEN b.peak_drop > a.peak_drop THEN 'Set 2' ELSE 'Tie' END AS more_fatigue,
 round(CASE WHEN least(abs(a.avg_value), abs(b.avg_value)) <= 1e-9 THEN 0 ELSE abs(a.avg_value - b.avg_value) / least(abs(a.avg_value), abs(b.avg_value)) * 100 END, 6) AS activation_difference,
 round(CASE WHEN least(a.avg_peak, b.avg_peak) = 0 THEN 0 ELSE (greatest(a.avg_peak, b.avg_peak) - least(a.avg_peak, b.avg_peak)) / least(a.avg_peak, b.avg_peak) * 100 END, 6) AS peak_difference
FROM pair JOIN sm a ON a.recording_id = newer JOIN sm b ON b.recording_id = older""")
def cmp_4_two_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = compare.newest_pair(_recordings(spark, sf_dir).filter("test_type = 'workout_set'"))
    return compare.compare_pairs(pairs, analysis.summaries(_ev(spark, sf_dir)))


_MATCHED = """, cn AS (SELECT recording_id, max(rep_no) AS n FROM rm GROUP BY 1),
mm AS (SELECT newer, older, least(x.n, y.n) AS m FROM pair JOIN cn x ON x.recording_id = newer JOIN cn y ON y.recording_id = older WHERE x.n <> y.n),
sd AS (SELECT newer, older, m, 'a' AS side, newer AS recording_id FROM mm UNION ALL SELECT newer, older, m, 'b', older FROM mm),
mv AS (SELECT newer, older, m, side, round(sum(peak_value), 6) / count(*) AS p, round(sum(mean_value), 6) / count(*) AS v, round(sum(peak_value) FILTER (rep_no <= m // 2), 6) / nullif(count(*) FILTER (rep_no <= m // 2), 0) AS h1, round(sum(peak_value) FILTER (rep_no > m // 2), 6) / nullif(count(*) FILTER (rep_no > m // 2), 0) AS h2
  FROM sd JOIN rm USING (recording_id) WHERE rep_no <= m GROUP BY ALL),
mw AS (SELECT *, coalesce(CASE WHEN h1 > 0 THEN (h1 - h2) / h1 * 100 END, 0) AS d FROM mv),
mt AS (SELECT a.newer, a.older, a.m AS matched_reps, round(a.p, 6) AS a_avg_peak, round(a.v, 6) AS a_avg_value, round(a.d, 6) AS a_peak_drop, round(b.p, 6) AS b_avg_peak, round(b.v, 6) AS b_avg_value, round(b.d, 6) AS b_peak_drop,
  CASE WHEN a.v > b.v THEN 'Set 1' WHEN b.v > a.v THEN 'Set 2' ELSE 'Tie' END AS matched_activation, CASE WHEN a.p > b.p THEN 'Set 1' WHEN b.p > a.p THEN 'Set 2' ELSE 'Tie' END AS matched_peak,
  CASE WHEN greatest(a.d, b.d) <= 5 THEN 'Neither' WHEN a.d > b.d THEN 'Set 1' WHEN b.d > a.d THEN 'Set 2' ELSE 'Tie' END AS matched_fatigue,
  round(coalesce(abs(a.v - b.v) / nullif(least(a.v, b.v), 0) * 100, 0), 6) AS matched_difference, round(coalesce(abs(a.p - b.p) / nullif(least(a.p, b.p), 0) * 100, 0), 6) AS matched_peak_difference, round(abs(a.d - b.d), 6) AS matched_fatigue_points
  FROM mw a JOIN mw b ON a.newer = b.newer AND a.older = b.older AND a.side = 'a' AND b.side = 'b')
"""


@query(_REPS + _RECS.replace("WITH ", ", ", 1) + _PAIR + _MATCHED + "SELECT newer, older, matched_reps, matched_activation, matched_peak, matched_fatigue, " + ", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in "a_avg_peak a_avg_value a_peak_drop b_avg_peak b_avg_value b_peak_drop matched_difference matched_peak_difference matched_fatigue_points".split()) + " FROM mt")
def jn_10_matched_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = compare.newest_pair(_recordings(spark, sf_dir).filter("test_type = 'workout_set'"))
    return _fours(compare.matched_reps(pairs, analysis.repetitions(_ev(spark, sf_dir))))


@query(_REPS + "SELECT i.recording_id, i.seq, i.rep_no FROM inr i")
def jn_8_samples_in_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    s = smoothing.centered_average(ev)
    return detect.samples_in_reps(ev, detect.detect(s, smoothing.thresholds(s))).select("recording_id", "seq", "rep_no")


@query(_REPS + "SELECT s.recording_id, s.seq, min(p.rep_no)::BIGINT AS region_no FROM s1 s LEFT JOIN reps p ON p.recording_id = s.recording_id AND s.time_s BETWEEN p.start_time AND p.end_time GROUP BY ALL")
def jn_7_first_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    s = smoothing.centered_average(ev)
    regions = detect.detect(s, smoothing.thresholds(s)).withColumnRenamed("rep_no", "region_no")
    return matching.first_region(ev, regions).select("recording_id", "seq", "region_no")


@query(_REPS + """, b AS (SELECT recording_id AS session_id, end_time, lead(start_time) OVER w AS nx, row_number() OVER w AS k FROM reps WINDOW w AS (PARTITION BY recording_id ORDER BY rep_no))
SELECT session_id, k::BIGINT AS boundary_index, round((end_time + nx) / 2, 6) AS boundary_time FROM b WHERE nx IS NOT NULL""")
def win_10_human_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _smooth(spark, sf_dir)
    r = detect.detect(s, smoothing.thresholds(s)).select(F.col("recording_id").alias("session_id"), F.col("rep_no").alias("rep_number"), "start_time", "end_time", F.lit("high").alias("confidence"))
    return matching.human_boundaries(r).select("session_id", "boundary_index", "boundary_time")


_CAND = """WITH c AS (SELECT l.doc_id, (l.doc_id % 20)::BIGINT AS session_id, l.quality = 1 AS truth, l.toxic = 0 AS said, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id))
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    return c.select("doc_id", (F.col("doc_id") % 20).alias("session_id"), (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("said"), F.col("n_chars").alias("score"))


@query(_CAND + """, g AS (SELECT session_id, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn, count(*) FILTER (NOT truth AND NOT said) AS tn FROM c GROUP BY 1),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM g)
SELECT session_id, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy FROM q""")
def agg_22_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.confusion(_candidates(spark, sf_dir), F.col("truth"), F.col("said"), "session_id")


@query(_CAND + """, b AS (SELECT session_id, score, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS q FROM c GROUP BY ALL),
t AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY session_id) AS pp, sum(q) OVER (PARTITION BY session_id) AS qq FROM b WINDOW w AS (PARTITION BY session_id ORDER BY score DESC))
SELECT session_id, round(sum(q * (tp - p / 2)) / max(pp * qq), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / max(pp), 6) AS average_precision FROM t WHERE pp > 0 AND qq > 0 GROUP BY session_id""")
def agg_23_ranking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ranking_scores(_candidates(spark, sf_dir), F.col("truth"), F.col("score"), "session_id")


@query(_CAND + """SELECT doc_id, session_id, CASE WHEN ('0x' || substr(md5('split' || session_id::VARCHAR), 1, 6))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM c""")
def set_1_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.hash_split(_candidates(spark, sf_dir), "session_id").select("doc_id", "session_id", "part")


@query(_RECS + """, x AS (SELECT recording_id AS r, concat_ws(',', CASE WHEN trim(weight) = '' THEN 'weight' END, CASE WHEN trim(side) = '' THEN 'side' END) AS missing, exercise, weight, side FROM rc)
SELECT exercise, weight, side, missing, count(*)::BIGINT AS sets, min(r) AS first_recording FROM x GROUP BY ALL""")
def agg_20_group_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.group_sets(_recordings(spark, sf_dir))


@query(_RECS + """SELECT exercise, side, weight, count(DISTINCT participant_id)::BIGINT AS participants, count(*)::BIGINT AS recordings FROM rc GROUP BY GROUPING SETS ((exercise), (side), (weight), ())""")
def agg_21_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, by = _recordings(spark, sf_dir), [F.col(c) for c in ("exercise", "side", "weight")]
    return r.groupingSets([[c] for c in by] + [[]], *by).agg(F.count_distinct("participant_id").alias("participants"), F.count(F.lit(1)).alias("recordings"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CASE WHEN p_size * 97 < 1024 THEN (p_size * 97)::VARCHAR || ' B' ELSE format('{:.1f} KB', p_size * 97 / 1024.0) END AS size_text FROM part""")
def fn_1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.file_size(F.col("p_size") * 97).alias("size_text"))


@query("""WITH s AS (SELECT s_suppkey, (s_suppkey % 4 + 1)::BIGINT AS reps FROM supplier),
x AS (SELECT s_suppkey, unnest(range(1, reps + 1)) AS rep FROM s), p AS (SELECT s_suppkey, rep, unnest([1, 2, 3, 4]) AS k FROM x),
d AS (SELECT *, ['lift', 'hold', 'lower', 'rest'][k] AS phase, [2.0, 1.0, 2.5, 0.0][k]::DOUBLE AS duration FROM p), e AS (SELECT * FROM d WHERE duration > 0)
SELECT s_suppkey AS session_id, rep::BIGINT AS rep, phase, round(sum(duration) OVER w - duration, 3) AS start_time, round(sum(duration) OVER w, 3) AS end_time FROM e WINDOW w AS (PARTITION BY s_suppkey ORDER BY rep, k)""")
def fn_5_cue_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("session_id"), (F.col("s_suppkey") % 4 + 1).alias("reps"), F.lit(2.0).alias("lift"), F.lit(1.0).alias("hold"), F.lit(2.5).alias("lower"), F.lit(0.0).alias("rest"))
    return text.cue_schedule(s)


@query("""SELECT s_suppkey AS session_id, CASE WHEN s_suppkey % 11 = 0 THEN 'missing manifest field' WHEN s_suppkey % 7 = 0 THEN 'missing annotations' WHEN s_suppkey % 5 = 0 THEN 'annotations not locked' WHEN s_suppkey % 3 = 0 THEN 'missing recording'
 WHEN s_suppkey % 13 = 0 THEN 'invalid annotations' WHEN s_suppkey % 17 = 0 THEN 'no repetitions' ELSE 'eligible' END AS reason FROM supplier""")
def val_3_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        i.alias("session_id"), F.when(i % 11 != 0, "p").alias("participant_id"), F.when(i % 7 == 0, None).when(i % 5 == 0, "reviewed").otherwise("locked").alias("annotation_status"), (i % 3 != 0).alias("has_csv"),
        F.when(i % 13 == 0, 1).otherwise(0).alias("n_errors"), F.when(i % 17 == 0, 0).otherwise(4).alias("n_reps"))
    return matching.eligibility(s).select("session_id", "reason")


@query()
def seg_9_valley_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive splitting and a dynamic programme: beyond SQL; tests hold it against signals with known repetitions."""
    return analysis.valley_detection(signals.supplier_recordings(spark, sf_dir))


@query()
def agg_5_adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.adaptive_thresholds(_smooth(spark, sf_dir))


@query()
def jn_6_matched_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _smooth(spark, sf_dir)
    reps = detect.detect(s, smoothing.thresholds(s)).select(F.col("recording_id").alias("session_id"), F.col("rep_no").alias("rep_number"), "start_time", "end_time", F.lit("").alias("confidence"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("seq")).cast("long")
    candidates = smoothing.local_minima(s).select(F.col("recording_id").alias("session_id"), "seq", "time_s").withColumn("cand_index", number).select("session_id", "cand_index", "time_s")
    return matching.match_candidates(candidates, matching.human_boundaries(reps))


@query()
def str_2_set_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = signals.event_recordings(spark, sf_dir, step_s=0.25).select("recording_id", F.col("time_s"), F.col("raw").alias("value"))
    r = _recordings(spark, sf_dir)
    fitting = calibration.newest_compatible(r, r.filter("test_type = 'calibration'").withColumnRenamed("recording_id", "calibration_id"))
    known = calibration.tail_calibration(_ev(spark, sf_dir)).withColumnRenamed("recording_id", "calibration_id")
    return lifecycle.replay(lifecycle.with_calibration(readings, fitting.join(known, "calibration_id")))


@query(_S + ", x AS (SELECT *, max(time_s) OVER (PARTITION BY recording_id) AS e FROM s1) SELECT recording_id, count(*)::BIGINT AS n, min(seq) AS first_seq FROM x WHERE round(e - time_s, 6) <= 3 GROUP BY ALL")
def win_16_recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = smoothing.recent_window(_ev(spark, sf_dir), 3.0)
    return recent.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query(_S + """, c AS (SELECT *, CASE WHEN raw >= 60 THEN 1 WHEN raw <= 20 THEN 0 END AS x FROM s1),
a AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) = 1 AS active FROM c),
b AS (SELECT *, CASE WHEN active THEN coalesce(time_s - lag(time_s) OVER w, 0) ELSE 0 END AS st, CASE WHEN active AND NOT coalesce(lag(active) OVER w, false) THEN 1 ELSE 0 END AS ed, coalesce(lead(time_s) OVER w, time_s) AS nx FROM a WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
d AS (SELECT *, sum(ed) OVER (PARTITION BY recording_id ORDER BY seq) AS ep FROM b),
e AS (SELECT recording_id, ep, min(time_s) AS s, max(nx) AS e FROM d WHERE active GROUP BY ALL HAVING round(max(nx) - min(time_s), 6) >= 0.5),
f AS (SELECT *, lag(e) OVER (PARTITION BY recording_id ORDER BY ep) AS pb FROM e), g AS (SELECT recording_id, count(*) AS n FROM f WHERE pb IS NULL OR round(s - pb, 6) >= 0.75 GROUP BY 1)
SELECT d.recording_id, round(sum(st), 6) AS active_time, coalesce(max(g.n), 0)::BIGINT AS episodes FROM d LEFT JOIN g USING (recording_id) GROUP BY d.recording_id""")
def win_13_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.activity(smoothing.hysteresis(_ev(spark, sf_dir), F.lit(60.0), F.lit(20.0)))


_FIELDS = compare.STRICT_FIELDS + compare.OPTIONAL_FIELDS
#: Every workout with the one before it of its participant, and nine fields of metadata of both.
_NEXT = """, mf AS (SELECT recording_id, CASE WHEN recording_id % 13 = 0 THEN '' ELSE participant_id::VARCHAR END AS participant_id, muscle, side, CASE WHEN recording_id % 12 = 5 THEN 'press' ELSE exercise END AS exercise_name, weight,
  ['', 'live', 'replay'][(recording_id % 3 + 1)::INT] AS source_type, CASE recording_id % 14 WHEN 3 THEN '' WHEN 4 THEN 'dataset' ELSE test_type END AS test_type, CASE WHEN recording_id % 4 = 2 THEN 'manual' WHEN recording_id % 4 = 3 THEN ' auto ' END AS set_end_rule,
  CASE WHEN recording_id % 10 > 6 THEN 'side' ELSE 'set' END AS comparison_target FROM rc),
nw AS (SELECT recording_id AS newer, lag(recording_id) OVER (PARTITION BY participant_id ORDER BY mtime, recording_id DESC) AS older FROM rc WHERE test_type = 'workout_set'), nb AS (SELECT * FROM nw WHERE older IS NOT NULL),
fd AS (SELECT unnest(['participant_id', 'muscle', 'side', 'exercise_name', 'weight', 'source_type', 'test_type', 'set_end_rule', 'comparison_target']) AS field, unnest(range(9)) AS i),
fl0 AS (SELECT recording_id, unnest([participant_id, muscle, side, exercise_name, weight, source_type, test_type, set_end_rule, comparison_target]) AS v, unnest(range(9)) AS i FROM mf), fv AS (SELECT recording_id, i, trim(coalesce(v, '')) AS v FROM fl0),
fw AS (SELECT newer, older, a.i, CASE WHEN a.v = '' OR b.v = '' THEN CASE WHEN a.i < 5 THEN field || ' missing' END WHEN a.v <> b.v THEN field || ' differs: ' || a.v || ' / ' || b.v END AS said FROM nb JOIN fv a ON a.recording_id = newer JOIN fv b ON b.recording_id = older AND b.i = a.i JOIN fd ON fd.i = a.i),
md AS (SELECT newer, older, coalesce(string_agg(said, '; ' ORDER BY i), '') AS warnings FROM fw GROUP BY newer, older)
"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of workouts that follow each other, with their metadata."""
    r, i = _recordings(spark, sf_dir), F.col("recording_id")
    before = F.lag("recording_id").over(Window.partitionBy("participant_id").orderBy("mtime", F.desc("recording_id")))
    pairs = r.filter("test_type = 'workout_set'").select(i.alias("newer"), before.alias("older")).filter("older is not null")
    told = r.withColumns({
        "participant_id": F.when(i % 13 == 0, "").otherwise(F.col("participant_id").cast("string")), "exercise_name": F.when(i % 12 == 5, "press").otherwise(F.col("exercise")), "source_type": F.element_at(F.array(F.lit(""), F.lit("live"), F.lit("replay")), (i % 3 + 1).cast("int")),
        "test_type": F.when(i % 14 == 3, "").when(i % 14 == 4, "dataset").otherwise(F.col("test_type")), "set_end_rule": F.when(i % 4 == 2, "manual").when(i % 4 == 3, " auto "), "comparison_target": F.when(i % 10 > 6, "side").otherwise("set")})
    return compare.metadata_warnings(compare.side_by_side(pairs, told, _FIELDS))


@query(_RECS + _NEXT + "SELECT newer, older, warnings, warnings = '' AS compatible_metadata FROM md")
def cmp_2_metadata_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("newer", "older", "warnings", "compatible_metadata")


@query(_CAND + "SELECT count(*) FILTER (truth) AS positive, count(*) FILTER (NOT truth) AS negative, round(avg(truth::INT), 6) AS fraction, count(DISTINCT session_id) AS groups FROM c")
def agg_25_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_balance(_candidates(spark, sf_dir), F.col("truth"), "session_id")


@query(_CAND + "SELECT session_id, count(*) FILTER (truth) AS true_count, count(*) FILTER (said) AS predicted_count, count(*) FILTER (said) - count(*) FILTER (truth) AS error, abs(count(*) FILTER (said) - count(*) FILTER (truth)) AS absolute_error FROM c GROUP BY 1")
def agg_24_count_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import classify

    return classify.count_errors(_candidates(spark, sf_dir).select("session_id", F.col("truth").cast("double").alias("label"), F.col("said").alias("predicted")))


@query(_CAND + ", x AS (SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 'train' WHEN doc_id % 3 = 0 THEN 'train' ELSE 'test' END AS part FROM c) SELECT session_id, count(DISTINCT part) AS parts FROM x GROUP BY 1 HAVING count(DISTINCT part) > 1")
def val_7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _candidates(spark, sf_dir).withColumn("part", F.when((F.col("session_id") % 3 == 0) | (F.col("doc_id") % 3 == 0), "train").otherwise("test"))
    return matching.leaks(split, "session_id")


@query(_SUMMARY + _RECS.replace("WITH ", ", ", 1) + """, sd AS (SELECT participant_id, lower(trim(side)) AS side, avg_value FROM sm JOIN rc USING (recording_id))
SELECT participant_id, side, count(*)::BIGINT AS sets, round(round(sum(avg_value), 6) / count(*), 6) AS average, round(CASE WHEN count(*) = 2 THEN CASE WHEN min(abs(avg_value)) <= 1e-9 THEN 0 ELSE (max(avg_value) - min(avg_value)) / min(avg_value) * 100 END END, 6) AS repeat_difference FROM sd GROUP BY ALL""")
def agg_26_side_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = analysis.summaries(_ev(spark, sf_dir)).join(_recordings(spark, sf_dir), "recording_id").withColumn("side", calibration.folded(F.col("side")))
    return metrics.side_averages(sets, "avg_value")


@query(_S + _RECS.replace("WITH ", ", ", 1) + """, lv AS (SELECT participant_id, weight, round(round(sum(raw), 6) / count(*), 1) AS v FROM s1 JOIN rc USING (recording_id) GROUP BY ALL)
SELECT participant_id, arg_min(weight, {'a': -v, 'b': weight}) AS highest_at, arg_min(weight, {'a': v, 'b': weight}) AS lowest_at FROM lv GROUP BY 1 HAVING count(*) >= 2""")
def agg_27_weight_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _ev(spark, sf_dir).join(_recordings(spark, sf_dir), "recording_id").groupBy("participant_id", "weight").agg(detect.steady_mean("raw").alias("v"))
    return metrics.ladder_extremes(levels, "v")


def _report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with every third one calibrated at 10 to 70."""
    ev = _ev(spark, sf_dir)
    cal = ev.select("recording_id").distinct().filter("recording_id % 3 = 0").select("recording_id", F.lit(10.0).alias("baseline"), F.lit(60.0).alias("signal_range"), F.lit(True).alias("usable"))
    return report.facts(ev, cal)


@query(_REPS + """, ww AS (SELECT recording_id, round(round(sum(raw), 6) / count(*), 6) AS overall_avg, round(max(raw), 6) AS overall_peak, round(avg(greatest(0, (raw - 10) / 60.0::DOUBLE * 100)) FILTER (recording_id % 3 = 0), 6) AS norm_overall FROM s1 GROUP BY 1),
hv AS (SELECT *, rep_no <= count(*) OVER (PARTITION BY recording_id) // 2 AS first FROM rm),
hr AS (SELECT recording_id, count(*) AS rep_count, avg(peak_value) FILTER (first) AS fp, avg(peak_value) FILTER (NOT first) AS sp, avg(mean_activation) AS activation FROM hv GROUP BY 1),
nr AS (SELECT recording_id, avg(v) AS norm_reps, max(p) AS norm_peak FROM (SELECT recording_id, rep_no, avg(greatest(0, (raw - 10) / 60.0::DOUBLE * 100)) AS v, max(greatest(0, (raw - 10) / 60.0::DOUBLE * 100)) AS p FROM inr WHERE recording_id % 3 = 0 GROUP BY ALL) GROUP BY 1)
SELECT recording_id, coalesce(rep_count, 0) AS rep_count, overall_avg, overall_peak, round(round(coalesce(activation, 0), 6) + 1e-7, 4) AS avg_activation, round(round(coalesce(fp, 0), 6) + 1e-7, 4) AS first_half_peak, round(round(coalesce(sp, 0), 6) + 1e-7, 4) AS second_half_peak,
  round(round(norm_overall, 6) + 1e-7, 4) AS norm_overall, CASE WHEN recording_id % 3 = 0 THEN round(round(coalesce(norm_reps, 0), 6) + 1e-7, 4) END AS norm_reps, CASE WHEN recording_id % 3 = 0 THEN round(round(coalesce(norm_peak, 0), 6) + 1e-7, 4) END AS norm_peak
FROM ww LEFT JOIN hr USING (recording_id) LEFT JOIN nr USING (recording_id)""")
def fn_4_report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _report_facts(spark, sf_dir)
    return f.select("recording_id", "rep_count", "overall_avg", "overall_peak", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("avg_activation", "first_half_peak", "second_half_peak", "norm_overall", "norm_reps", "norm_peak")])


@query()
def fn_4_set_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are printed to one decimal, which engines round differently at the edge; so there is no SQL."""
    side = F.when(F.col("recording_id") % 2 == 0, "left").otherwise("right")
    meta = _ev(spark, sf_dir).select("recording_id").distinct().select("recording_id", F.create_map(F.lit("side"), side).alias("metadata"))
    return report.set_report(_report_facts(spark, sf_dir), meta)


@query()
def seg_11_candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.candidate_features(smoothing.with_thresholds(analysis.smoothed(signals.supplier_recordings(spark, sf_dir))), None)


_FILES = _RECS + """, fl AS (SELECT recording_id, mtime, CASE WHEN recording_id % 5 = 2 THEN 'fake' ELSE 'real' END AS data_type, test_type, CASE WHEN recording_id % 9 = 4 THEN 'Excluded' END AS status,
 CASE WHEN recording_id % 11 = 3 THEN 'a Diagnostic run' WHEN recording_id % 11 = 5 THEN 'not excluded' END AS notes FROM rc)
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("recording_id")
    return _recordings(spark, sf_dir).select("recording_id", "mtime", "participant_id", F.when(i % 5 == 2, "fake").otherwise("real").alias("data_type"), "test_type", F.when(i % 9 == 4, "Excluded").alias("status"), F.when(i % 11 == 3, "a Diagnostic run").when(i % 11 == 5, "not excluded").alias("notes"))


@query(_FILES + "SELECT recording_id, mtime FROM fl WHERE data_type = 'real' AND test_type = 'workout_set' AND status IS NULL AND NOT coalesce(contains(lower(notes), 'diagnostic'), false)")
def src_8_workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.workouts(_files(spark, sf_dir)).select("recording_id", "mtime")


@query(_FILES + ", x AS (SELECT recording_id % 10 AS participant_id, recording_id, row_number() OVER (PARTITION BY recording_id % 10 ORDER BY mtime DESC, recording_id) AS k FROM fl WHERE data_type = 'real' AND test_type = 'workout_set' AND status IS NULL AND NOT coalesce(contains(lower(notes), 'diagnostic'), false)) SELECT participant_id, recording_id FROM x WHERE k = 1")
def src_8_newest_workout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.newest(catalog.workouts(_files(spark, sf_dir)), "participant_id")


@query(_RECS + "SELECT recording_id, CASE WHEN recording_id % 4 <> 0 THEN muscle ELSE '' END AS muscle, CASE WHEN recording_id % 4 <> 0 AND recording_id % 6 <> 1 THEN side ELSE '' END AS side, recording_id % 4 <> 0 AS has_metadata FROM rc")
def jn_1_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recordings(spark, sf_dir)
    entry = lambda c: F.create_map(F.lit(c), F.col(c))
    said = r.filter("recording_id % 4 != 0").select("recording_id", F.when(F.col("recording_id") % 6 == 1, entry("muscle")).otherwise(F.map_concat(entry("muscle"), entry("side"))).alias("metadata"))
    return catalog.with_metadata(r.select("recording_id"), said, ("muscle", "side"))


@query(_S + "SELECT recording_id, seq, round((seq + recording_id % 3) * 0.1::DOUBLE - first_value((seq + recording_id % 3) * 0.1::DOUBLE) OVER (PARTITION BY recording_id ORDER BY seq), 6) AS time_s FROM s1")
def prj_1_relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = _ev(spark, sf_dir).withColumn("time_s", (F.col("seq") + F.col("recording_id") % 3) * F.lit(0.1))
    return timing.relative_time(shifted).select("recording_id", "seq", F.round("time_s", 6).alias("time_s"))


@query(_RECS + "SELECT recording_id, recording_id % 3 = 1 AS is_current FROM rc")
def prj_9_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, i = _recordings(spark, sf_dir), F.col("recording_id")
    made = r.filter(i % 3 != 0).select(i, (F.col("mtime") - F.when(i % 3 == 2, F.expr("interval 1 second")).otherwise(F.expr("interval 0 second"))).alias("mtime"))
    return catalog.freshness(r, made)


@query(_S + """, d AS (SELECT recording_id, seq, seq * 100 + (seq // 10) * 40 AS host_ms, CASE WHEN seq % 6 <> 4 THEN 5000 + seq * 100 + CASE WHEN seq >= 25 THEN 7000 ELSE 0 END END AS device_ms FROM s1),
e AS (SELECT *, host_ms - first_value(host_ms) OVER w AS host_elapsed_ms, first_value(device_ms IGNORE NULLS) OVER w AS f, last_value(device_ms IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM d WINDOW w AS (PARTITION BY recording_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, host_elapsed_ms - (device_ms - f) AS drift_ms FROM e)
SELECT recording_id, seq, host_elapsed_ms, coalesce(device_ms - f, host_elapsed_ms) AS time_ms, drift_ms, CASE WHEN device_ms - p > 5000 THEN device_ms - p END AS gap_ms, coalesce(bool_or(abs(drift_ms) >= 1000) OVER (PARTITION BY recording_id ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS drift_warning FROM g""")
def str_3_sample_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    r = _ev(spark, sf_dir).select("recording_id", "seq", (s * 100 + F.floor(s / 10) * 40).alias("host_ms"), F.when(s % 6 != 4, 5000 + s * 100 + F.when(s >= 25, 7000).otherwise(0)).alias("device_ms"))
    return timing.sample_timing(r).drop("host_ms", "device_ms")


_GATE = _SETS + _QUALITY + _RECS.replace("WITH ", ", ", 1) + _NEXT + """, gq AS (SELECT s.recording_id, s.calibration_usable AS us, q.cross_session AS cs, trim(m.side) AS side, coalesce(trim(l.side), '') AS lent, q.signature FROM sets s JOIN quality q USING (recording_id) JOIN rc m USING (recording_id) LEFT JOIN cl0 ON g = s.recording_id // 3 AND s.recording_id % 9 <> 5 LEFT JOIN rc l ON l.recording_id = lender),
gp AS (SELECT newer, older, warnings, a.us AND b.us AS us, a.cs AND b.cs AS cs, a.side <> '' AND b.side <> '' AND a.side <> b.side AS ap, (a.lent <> '' AND a.lent <> a.side) OR (b.lent <> '' AND b.lent <> b.side) AS ot, a.signature IS NOT DISTINCT FROM b.signature AS sg FROM md JOIN gq a ON a.recording_id = newer JOIN gq b ON b.recording_id = older),
gg AS (SELECT newer, older, us AND cs AND ap AS exploratory, CASE WHEN NOT us THEN 'no usable calibration' WHEN NOT cs THEN 'calibration too poor' WHEN ap AND ot THEN 'calibration of the other side' WHEN ap THEN 'sides on trial' WHEN NOT sg THEN 'different calibrations' WHEN warnings <> '' THEN 'metadata differs' ELSE 'ok' END AS gate FROM gp)
"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring sets and whether their normalised values may be compared, from the quality of their calibrations."""
    quality_of = analysis.calibration_quality(_ev(spark, sf_dir), _borrowed(spark, sf_dir))
    r = _recordings(spark, sf_dir).select("recording_id", F.trim("side").alias("side"))
    lender = _borrowed(spark, sf_dir).select("recording_id", F.regexp_extract("source_csv", "[0-9]+", 0).cast("long").alias("lender")).join(r.select(F.col("recording_id").alias("lender"), F.col("side").alias("calibration_side")), "lender")
    facts = quality_of.select("recording_id", (F.col("level") != "missing").alias("there"), calibration.is_usable().alias("ok"), "cross_session", "signature").join(r, "recording_id").join(lender, "recording_id", "left")
    facts = facts.withColumn("usable", F.col("there") & F.col("ok"))
    return compare.normalised_gate(compare.side_by_side(_neighbours(spark, sf_dir).select("newer", "older", "compatible_metadata"), facts, ("usable", "cross_session", "side", "calibration_side", "signature")))


@query(_GATE + "SELECT newer, older, gate, gate IN ('ok', 'sides on trial') AS allowed, exploratory FROM gg")
def cmp_3_normalised_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("newer", "older", "gate", "allowed", "exploratory")


@query(_GATE + """, dm AS (SELECT unnest(['mean_activation', 'median_activation', 'peak_activation', 'total_integral', 'active_time', 'mean_duration', 'duration_variation', 'change', 'slope', 'norm_mean_activation', 'norm_median_activation', 'norm_peak_activation', 'norm_integral', 'norm_change', 'norm_slope']) AS metric, unnest(range(15)) AS i),
dv AS (SELECT recording_id, unnest(range(15)) AS i, unnest([mean_activation, median_activation, peak_activation, total_integral, active_time, mean_duration, duration_variation, change, slope, norm_mean_activation, norm_median_activation, norm_peak_activation, norm_integral, norm_change, norm_slope]) AS v FROM sets)
SELECT newer, older, metric, round(a.v + 1e-7, 4) AS a, round(b.v + 1e-7, 4) AS b, round(round(b.v - a.v, 6) + 1e-7, 4) AS delta, round(CASE WHEN a.v IS NULL OR b.v IS NULL THEN NULL WHEN least(abs(a.v), abs(b.v)) <= 1e-9 THEN 0 ELSE abs(a.v - b.v) / least(abs(a.v), abs(b.v)) * 100 END + 1e-7, 2) AS percent
FROM gg JOIN dv a ON a.recording_id = newer JOIN dv b ON b.recording_id = older AND b.i = a.i JOIN dm ON dm.i = a.i WHERE a.i < 9 OR gate IN ('ok', 'sides on trial')""")
def cmp_1_metric_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.metric_differences(_gated(spark, sf_dir).select("newer", "older", "allowed"), analysis.set_analysis(_ev(spark, sf_dir), _borrowed(spark, sf_dir)))
    return _fours(rows.withColumn("percent", F.round(F.col("percent") + 1e-7, 2)))


_TREND = _SUMMARY + _RECS.replace("WITH ", ", ", 1) + _PAIR + """, tp AS (SELECT newer, older, a.peak_drop AS x, b.peak_drop AS y, a.rep_count AS na, b.rep_count AS nb, a.avg_value AS va, b.avg_value AS vb, a.highest_peak AS pa, b.highest_peak AS pb, a.avg_peak AS qa, b.avg_peak AS qb
  FROM pair JOIN sm a ON a.recording_id = newer JOIN sm b ON b.recording_id = older),
td AS (SELECT *, CASE WHEN abs(x) <= 5 THEN 'steady' WHEN x > 0 THEN 'falling' ELSE 'rising' END AS dx, CASE WHEN abs(y) <= 5 THEN 'steady' WHEN y > 0 THEN 'falling' ELSE 'rising' END AS dy, abs(abs(x) - abs(y)) AS gap FROM tp),
tt AS (SELECT *, CASE WHEN dx = 'steady' AND dy = 'steady' THEN 'both steady'
  WHEN dx = 'steady' OR dy = 'steady' THEN 'Set 1 ' || dx || CASE WHEN dx <> 'steady' THEN ' by ' || printf('%.1f%%', abs(x)) ELSE '' END || ', Set 2 ' || dy || CASE WHEN dy <> 'steady' THEN ' by ' || printf('%.1f%%', abs(y)) ELSE '' END
  WHEN dx <> dy THEN 'Set 1 ' || dx || ', Set 2 ' || dy
  ELSE 'both ' || dx || ': ' || CASE WHEN gap = 0 THEN 'alike' ELSE CASE WHEN abs(x) > abs(y) THEN 'Set 1' ELSE 'Set 2' END || CASE WHEN gap >= 5 THEN ' clearly more' ELSE ' slightly more' END END END AS trend FROM td)
"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sets with their comparison and trend."""
    pairs = compare.newest_pair(_recordings(spark, sf_dir).filter("test_type = 'workout_set'"))
    both = compare.side_by_side(pairs, analysis.summaries(_ev(spark, sf_dir)), ("rep_count", "avg_value", "avg_peak", "highest_peak", "peak_drop"))
    return compare.trends(compare.compared(both))


@query(_TREND + "SELECT newer, older, trend FROM tt")
def cmp_5_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("newer", "older", "trend")


_NORM = _REPS + """, nr AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY raw) AS u, row_number() OVER (PARTITION BY recording_id ORDER BY raw DESC) AS d FROM s1),
cal AS (SELECT recording_id, round(avg(raw) FILTER (u <= greatest(1, floor(n * 10 / 100.0))), 9) AS baseline, round(avg(raw) FILTER (d <= greatest(1, floor(n * 10 / 100.0))), 9) AS max_flex FROM nr GROUP BY ALL),
na AS (SELECT s1.recording_id, seq, time_s, round(greatest(0, (raw - baseline) / round(max_flex - baseline, 9) * 100), 6) AS raw FROM s1 JOIN cal USING (recording_id) WHERE round(max_flex - baseline, 9) >= 1),
ni AS (SELECT p.*, s.raw, s.time_s - lag(s.time_s) OVER w AS dt, (s.raw + lag(s.raw) OVER w) / 2 AS pr FROM reps p JOIN na s ON s.recording_id = p.recording_id AND s.time_s BETWEEN p.start_time AND p.end_time WINDOW w AS (PARTITION BY p.recording_id, p.rep_no ORDER BY s.seq)),
nm AS (SELECT recording_id, rep_no, round(round(sum(raw), 6) / count(raw), 6) AS m, round(max(raw), 6) AS p, round(CASE WHEN count(*) = 1 THEN round(sum(raw), 6) / count(raw) * (end_time - start_time) ELSE coalesce(sum(pr * dt) FILTER (dt > 0), 0) END, 6) AS i FROM ni GROUP BY recording_id, rep_no, start_time, end_time),
nn AS (SELECT c.recording_id, round(coalesce(round(sum(m), 6) / count(m), 0), 6) AS norm_avg_value, round(coalesce(max(p), 0), 6) AS norm_peak, round(coalesce(round(sum(p), 6) / count(p), 0), 6) AS norm_avg_peak, round(coalesce(sum(i), 0), 6) AS norm_integral
  FROM cal c LEFT JOIN nm USING (recording_id) WHERE round(c.max_flex - c.baseline, 9) >= 1 GROUP BY 1)
"""


@query(_NORM + "SELECT recording_id, round(norm_avg_value, 3) AS norm_avg_value, round(norm_peak, 3) AS norm_peak, round(norm_avg_peak, 3) AS norm_avg_peak, round(norm_integral, 3) AS norm_integral FROM nn")
def agg_7_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    n = analysis.normalised_summaries(ev, calibration.tail_calibration(ev))
    return n.select("recording_id", *[F.round(c, 3).alias(c) for c in n.columns[1:]])


@query(_NORM + _RECS.replace("WITH ", ", ", 1) + _PAIR + """SELECT newer, older, CASE WHEN a.norm_avg_value > b.norm_avg_value THEN 'Set 1' WHEN b.norm_avg_value > a.norm_avg_value THEN 'Set 2' WHEN a.norm_avg_value = b.norm_avg_value THEN 'Tie' END AS normalised_activation,
 round(CASE WHEN least(a.norm_avg_value, b.norm_avg_value) = 0 THEN 0 ELSE abs(a.norm_avg_value - b.norm_avg_value) / least(a.norm_avg_value, b.norm_avg_value) * 100 END, 3) AS normalised_difference,
 CASE WHEN a.norm_peak > b.norm_peak THEN 'Set 1' WHEN b.norm_peak > a.norm_peak THEN 'Set 2' WHEN a.norm_peak = b.norm_peak THEN 'Tie' END AS normalised_peak,
 round(CASE WHEN least(a.norm_peak, b.norm_peak) = 0 THEN 0 ELSE abs(a.norm_peak - b.norm_peak) / least(a.norm_peak, b.norm_peak) * 100 END, 3) AS normalised_peak_difference FROM pair JOIN nn a ON a.recording_id = newer JOIN nn b ON b.recording_id = older""")
def cmp_4_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    pairs = compare.newest_pair(_recordings(spark, sf_dir).filter("test_type = 'workout_set'")).select("newer", "older")
    both = compare.normalised_block(pairs, analysis.normalised_summaries(ev, calibration.tail_calibration(ev)))
    return both.withColumns({c: F.round(c, 3) for c in ("normalised_difference", "normalised_peak_difference")})


_REMARK = lambda who, percent: f"CASE WHEN coalesce({percent}, 0) < 5 OR {who} = 'Tie' THEN 'about the same' ELSE {who} || ' higher' END"


@query(_TREND + _MATCHED + _CAL_TAIL + _BORROWED + """, nj AS (SELECT p.recording_id, p.rep_no, max(a.activation) AS pk, round(round(sum(a.activation), 6) / count(*), 6) AS mv FROM reps p JOIN act a ON a.recording_id = p.recording_id AND a.time_s BETWEEN p.start_time AND p.end_time GROUP BY ALL),
nk AS (SELECT u.recording_id, round(coalesce(round(sum(mv), 6) / count(mv), 0), 6) AS v, round(coalesce(max(pk), 0), 6) AS p FROM us u LEFT JOIN nj USING (recording_id) GROUP BY 1),
nq AS (SELECT newer, older, a.v AS nva, b.v AS nvb, a.p AS npa, b.p AS npb FROM pair JOIN nk a ON a.recording_id = newer JOIN nk b ON b.recording_id = older),
ti AS (SELECT tt.*, nva, mt.matched_reps AS mr, mt.matched_activation AS mwho, mt.matched_difference AS mdiff, CASE WHEN nva > nvb THEN 'Set 1' WHEN nvb > nva THEN 'Set 2' ELSE 'Tie' END AS nwv, coalesce(abs(nva - nvb) / nullif(least(nva, nvb), 0) * 100, 0) AS ndv, CASE WHEN npa > npb THEN 'Set 1' WHEN npb > npa THEN 'Set 2' ELSE 'Tie' END AS nwp, coalesce(abs(npa - npb) / nullif(least(npa, npb), 0) * 100, 0) AS ndp,
  CASE WHEN va > vb THEN 'Set 1' WHEN vb > va THEN 'Set 2' ELSE 'Tie' END AS wv, CASE WHEN pa > pb THEN 'Set 1' WHEN pb > pa THEN 'Set 2' ELSE 'Tie' END AS wp,
  CASE WHEN least(abs(va), abs(vb)) <= 1e-9 THEN 0 ELSE abs(va - vb) / least(abs(va), abs(vb)) * 100 END AS dv, CASE WHEN least(qa, qb) = 0 THEN 0 ELSE (greatest(qa, qb) - least(qa, qb)) / least(qa, qb) * 100 END AS dp FROM tt LEFT JOIN mt USING (newer, older) LEFT JOIN nq USING (newer, older))
SELECT newer, older, concat_ws('; ', CASE WHEN nva IS NULL THEN 'activation: ' || """ + _REMARK("wv", "dv") + " ELSE 'calibrated activation: ' || " + _REMARK("nwv", "ndv") + """ END, trend, 'repetitions: ' || CASE WHEN na = nb THEN 'equal' WHEN na > nb THEN 'Set 1 more' ELSE 'Set 2 more' END,
  'first ' || mr || ' of each, activation: ' || """ + _REMARK("mwho", "mdiff") + ", 'peak: ' || CASE WHEN nva IS NULL THEN " + _REMARK("wp", "dp") + " ELSE " + _REMARK("nwp", "ndp") + " END) AS insights FROM ti")
def cmp_6_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, pairs = _ev(spark, sf_dir), compare.newest_pair(_recordings(spark, sf_dir).filter("test_type = 'workout_set'")).select("newer", "older")
    block = compare.normalised_block(pairs, analysis.normalised_summaries(ev, _borrowed(spark, sf_dir)))
    matched = compare.matched_reps(pairs, analysis.repetitions(ev)).select("newer", "older", "matched_reps", "matched_activation", "matched_difference")
    rows = _compared(spark, sf_dir).join(block, ["newer", "older"]).join(matched, ["newer", "older"], "left")
    return compare.insights(rows).select("newer", "older", F.array_join("insights", "; ").alias("insights"))


@query()
def cmp_7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both detectors on every supplier's recording; the valley detector is beyond SQL, a test holds both against known repetitions."""
    rows = smoothing.with_thresholds(analysis.smoothed(signals.supplier_recordings(spark, sf_dir)))
    expected = rows.select("recording_id").distinct().withColumn("expected_reps", (F.col("recording_id") % 4).cast("string"))
    found = hybrid.detect(rows, None, kinds=(hybrid.THRESHOLD, "rep"))
    return compare.agreement_of(found.withColumn("by", F.when(F.col("kind") == "rep", "valley").otherwise("threshold")), expected)


@query("""SELECT s_suppkey AS session_id, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'locked' ELSE 'saved' END WHEN s_suppkey % 5 = 0 THEN 'no reason' ELSE 'saved' END AS outcome,
 CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'locked' ELSE 'draft' END WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'locked' WHEN s_suppkey % 7 = 1 THEN 'unreviewed' ELSE 'reviewed' END WHEN s_suppkey % 3 = 1 THEN 'draft' ELSE 'reviewed' END AS annotation_status FROM supplier""")
def val_4_annotation_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    old = s.filter((i % 2 == 0) | (i % 7 != 1)).select(i.alias("session_id"), F.when(i % 2 == 0, "locked").otherwise("reviewed").alias("annotation_status"))
    new = s.select(i.alias("session_id"), F.when(i % 3 == 0, "save").when(i % 3 == 1, "override").otherwise("unlock").alias("kind"), F.when(i % 5 != 0, "typo").alias("reason"), F.lit("draft").alias("new_status"))
    return quality.apply_updates(old, new)


@query(_S + _RECS.replace("WITH ", ", ", 1) + """, x AS (SELECT recording_id, max(raw) - min(raw) AS rg FROM s1 GROUP BY 1), nm AS (SELECT recording_id, round(avg((raw >= hi - greatest(2, (hi - lo) * 0.01::DOUBLE))::INT) * 100, 6) AS p FROM (SELECT *, max(raw) OVER w AS hi, min(raw) OVER w AS lo FROM s1 WINDOW w AS (PARTITION BY recording_id)) GROUP BY 1)
SELECT recording_id, concat_ws(';', CASE WHEN rg <= 2 THEN 'flat_signal' WHEN rg <= 20 THEN 'small_range' END, CASE WHEN recording_id % 4 <> 0 AND recording_id % 4 <> recording_id % 3 THEN 'rep_count_differs' END,
 CASE WHEN recording_id % 5 = 0 THEN 'no_calibration' WHEN trim(side) <> '' AND trim(side) <> 'right' THEN 'calibration_of_other_side' END, CASE WHEN recording_id % 6 = 0 THEN 'no_graph' WHEN recording_id % 6 = 1 THEN 'graph_older_than_summary' END,
 CASE WHEN recording_id % 13 = 2 THEN 'diagnostic_or_excluded' END, CASE WHEN p >= 3 THEN 'saturated' END) AS warnings FROM rc JOIN x USING (recording_id) JOIN nm USING (recording_id)""")
def val_6_recording_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, i = _ev(spark, sf_dir), F.col("recording_id")
    ranges = ev.groupBy("recording_id").agg((F.max("raw") - F.min("raw")).alias("signal_range"))
    facts = _recordings(spark, sf_dir).select(
        "recording_id", F.when(i % 4 == 0, "").otherwise((i % 4).cast("string")).alias("expected_reps"), (i % 3).alias("detected_reps"), (i % 5 != 0).alias("has_calibration"), F.lit("right").alias("calibration_side"), F.col("side").alias("required_side"),
        F.when(i % 6 != 0, F.when(i % 6 == 1, 1).otherwise(3)).alias("graph_mtime"), F.lit(2).alias("summary_mtime"), (i % 13 == 2).alias("is_excluded"))
    rows = facts.join(ranges, "recording_id").join(calibration.saturation(ev), "recording_id")
    return quality.recording_warnings(rows).select("recording_id", F.array_join("warnings", ";").alias("warnings"))


@query("""WITH b AS (SELECT s_suppkey AS session_id, 10.0::DOUBLE + s_suppkey AS b, (10.0::DOUBLE + s_suppkey) * CASE s_suppkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1 ELSE 0.001::DOUBLE END AS c FROM supplier)
SELECT session_id, round(c / b, 6) AS ratio FROM b WHERE session_id % 3 <> 1 AND session_id % 7 <> 0""")
def seg_12_unit_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("session_id"), (F.lit(10.0) + F.col("s_suppkey")).alias("boundary_time"))
    times = s.select("session_id", (F.col("boundary_time") * F.when(F.col("session_id") % 3 == 0, 1000.0).when(F.col("session_id") % 3 == 1, 1.0).otherwise(0.001)).alias("time_s"))
    return quality.unit_warnings(times, s, s.filter("session_id % 7 = 0"))


@query(_CAND + """, g AS (SELECT session_id, count(*) FILTER (said) - count(*) FILTER (truth) AS e FROM c GROUP BY 1)
SELECT round(avg(abs(e)), 6) AS mean_absolute_error, round(median(abs(e)), 6) AS median_absolute_error, round(avg((e = 0)::INT), 6) AS exact_share, count(*) FILTER (e > 0) AS too_many, count(*) FILTER (e < 0) AS too_few FROM g""")
def agg_24_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import classify

    return classify.count_error_summary(agg_24_count_errors(spark, sf_dir))


@query("""WITH b AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || (o_custkey % 3)::VARCHAR || '_' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS base, strftime(o_orderdate, '%Y-%m-%d %I:%M %p') AS shown FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS k FROM b) SELECT o_orderkey AS row_no, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS session_id, shown FROM n""")
def fn_2_session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_no"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 3).alias("participant_id"), F.col("o_orderpriority").alias("exercise"))
    return text.session_ids(o).select("row_no", "session_id", text.date_time(F.col("created_at")).alias("shown"))


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def fn_8_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    return quality.z_scores(p, "p_size", "p_retailprice").select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query(_CAND + "SELECT doc_id, session_id || ':' || (row_number() OVER (PARTITION BY session_id ORDER BY doc_id) - 1) || ':' || score AS row_key FROM c")
def set_5_row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.row_keys(_candidates(spark, sf_dir).withColumn("candidate_timestamp", F.col("score")), "doc_id").select("doc_id", "row_key")


def _annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers' recordings, a session of each, and its verified repetitions: those of the valley detector but for every seventh cut."""
    samples, i = signals.supplier_recordings(spark, sf_dir), F.col("recording_id")
    rows = smoothing.with_thresholds(analysis.smoothed(samples))
    reps = hybrid.detect(rows, None, kinds=("rep",)).filter("item % 7 != 3")
    intervals = reps.select(i.alias("session_id"), F.col("item").alias("rep_number"), "start_time", "end_time", F.when(F.col("item") % 3 == 0, "high").otherwise("").alias("confidence"))
    sessions = samples.select("recording_id").distinct().select(i, i.alias("session_id"), F.concat(F.lit("r"), i, F.lit(".csv")).alias("recording_filename"), (i % 7).cast("string").alias("participant_id"), F.lit("curl").alias("exercise"), F.when(i % 2 == 0, "left").otherwise("right").alias("side"), (i % 5).cast("string").alias("weight"), (i % 10 / 10).alias("confidence"))
    return samples, sessions, intervals


@query()
def src_11_candidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features are beyond SQL; tests hold labels and columns against a session worked out by hand."""
    from .plans import dataset

    return dataset.candidate_rows(*_annotated(spark, sf_dir), adaptive=False)


@query()
def ml_3_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and rule on the same held-out participants, from samples to scores."""
    from .plans import classify

    return classify.experiment(src_11_candidate_table(spark, sf_dir))["metrics"]
