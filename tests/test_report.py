"""Lines of a report from facts, and facts from samples."""

from tidewater.plans import report

from .test_detect import HEIGHTS, REST, bumps

FACTS = "recording_id string, rep_count long, strongest_rep long, set_duration double, avg_duration double, avg_peak double, peak_drop double, possible_fatigue boolean, overall_avg double, overall_peak double, avg_activation double, first_half_peak double, second_half_peak double, norm_overall double, norm_reps double, norm_peak double"


def test_lines(spark):
    told = spark.createDataFrame([
        ("a", 4, 2, 12.345, 2.0, 500.0, 20.04, True, 100.06, 700.0, 333.3, 550.0, 440.0, 31.0, 55.55, 110.1),
        ("b", 0, 0, 0.0, 0.0, 0.0, 0.0, False, 7.0, 9.0, 0.0, 0.0, 0.0, None, None, None),
        ("c", 2, 1, 3.0, 1.0, 5.0, -7.25, False, 7.0, 9.0, 0.0, 0.0, 0.0, 10.0, 20.0, 110.0),
    ], FACTS)
    meta = spark.createDataFrame([("a", {"side": "left", "notes": "", "weight": "5 kg", "other": "x"}), ("c", {})], "recording_id string, metadata map<string,string>")
    got = {r.recording_id: r.report.split("\n\n") for r in report.set_report(told, meta).collect()}
    assert [len(x) for x in got.values()].count(3) == 1 and len(got["a"]) == 3 and len(got["b"]) == len(got["c"]) == 2
    assert got["a"][0] == "Metadata\nSide: left\nWeight: 5 kg"
    numbers = got["a"][1].split("\n")
    assert len(numbers) == 16 and numbers[1:4] == ["Repetitions: 4", "Length: 12.35 s", "Mean signal: 100.1"] and numbers[10:12] == ["Change of activation between halves: down 20.0%", "Possible fatigue: yes"] and numbers[-1] == "Peak: 110.1%"
    assert "calibrate again" in got["a"][2] and "clearly weaker" in got["a"][2]
    assert len(got["b"][0].split("\n")) == 12 and "none is the strongest" in got["b"][1] and "no usable calibration" in got["b"][1] and "held" in got["b"][1]
    assert "up 7.2%" in got["c"][0] or "up 7.3%" in got["c"][0]
    assert "calibrate again" not in got["c"][1] and "stronger" in got["c"][1]


def test_facts(spark):
    made = {"set": REST + bumps(HEIGHTS, 70, 2.4, 1.8) + REST, "flat": [5.0] * 90}
    rows = [(k, i, round(i * 0.1, 9), float(v)) for k, vs in made.items() for i, v in enumerate(vs)]
    samples = spark.createDataFrame(rows, "recording_id string, seq long, time_s double, raw double")
    cal = spark.createDataFrame([("set", 50.0, 400.0, True), ("flat", 0.0, 10.0, True)], "recording_id string, baseline double, signal_range double, usable boolean")
    got = {r.recording_id: r for r in report.facts(samples, cal).collect()}
    assert got["set"].rep_count == len(HEIGHTS) and got["set"].overall_peak == max(made["set"]) and got["set"].first_half_peak > 0 < got["set"].second_half_peak
    assert abs(got["set"].norm_overall - (sum(made["set"]) / len(made["set"]) - 50) / 4) < 1e-4
    assert (got["flat"].rep_count, got["flat"].norm_overall, got["flat"].norm_reps, got["flat"].norm_peak) == (0, 50.0, 0.0, 0.0)
    bare = report.facts(samples, cal.limit(0)).filter("recording_id = 'set'").first()
    assert bare.norm_overall is None and bare.norm_reps is None and bare.norm_peak is None
