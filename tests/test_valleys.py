"""The judgement of valleys, sample by sample, and what a region's rows tell."""

import random
import time

import numpy as np
import pytest

from tidewater.operators import detect, hybrid, intervals, smoothing
from tidewater.plans import analysis

from .test_detect import HEIGHTS, bumps, frame


def plain_judgement(t, v, a, b, i, start):
    """A candidate cut by the definition, with loops."""
    left, right = max(v[a : i + 1]), max(v[i : b + 1])
    low, span, value = min(v[a : b + 1]), max(1.0, max(v[a : b + 1]) - min(v[a : b + 1])), v[i]
    drop = min(left, right) - value
    level, j, k = value + drop * 0.25, i, i
    while j > a and v[j - 1] <= level:
        j -= 1
    while k < b and v[k + 1] <= level:
        k += 1
    valley = t[k] - t[j]

    def center(x, y, peak):
        at = [t[m] for m in range(x, y + 1) if v[m] >= peak - max(10.0, span * 0.05)]
        return sum(at) / len(at)

    of_range, of_peak = drop / span, drop / max(1.0, min(left, right) - low)
    lc, rc = center(a, i, left), center(i, b, right)
    gap, strong = rc - lc, of_peak >= 0.8 and of_range >= 0.65 and round(valley, 9) >= 1.0
    reasons = [name for name, bad in (
        ("short_region", round(t[b] - t[a], 9) < 5), ("short_left", round(t[i] - t[a], 9) < 0.75), ("short_right", round(t[b] - t[i], 9) < 0.75), ("low_peak", min(left, right) < start), ("small_drop", drop < max(300, span * 0.25) and not strong),
        ("shallow", of_peak < 0.3), ("short_valley", round(valley, 9) < 0.12), ("close_centres", gap < 0.9)) if bad]
    return {"i": i, "value": value, "drop": drop, "of_peak": of_peak, "valley": valley, "gap": gap, "score": drop * of_peak * max(0.1, gap), "left_peak": left, "right_peak": right, "drop_from_left": left - value, "rebound": right - value, "of_range": of_range, "left_center": lc, "right_center": rc, "reasons": reasons}


def random_signal(seed, n):
    rng = random.Random(seed)
    v, at = [], rng.uniform(100, 900)
    for _ in range(n):
        at = max(0.0, at + rng.choice([-90, -40, 0, 0, 40, 90]) * rng.random())
        v.append(round(at, 3) if rng.random() < 0.8 else v[-1] if v else at)
    t = np.round(np.cumsum([rng.choice([0.05, 0.1, 0.2]) for _ in range(n)]), 9)
    return t, np.array(v)


@pytest.mark.parametrize("seed", range(6))
def test_all_valleys_of_a_segment_are_judged_as_one_by_one(seed):
    t, v = random_signal(seed, 150 + 40 * seed)
    s = hybrid._Signal(t, v, v, 400.0, 300.0)
    for a, b in ((0, len(v) - 1), (20, 90), (5, 40)):
        valleys = hybrid._valleys(s, a, b)
        got = hybrid.judge(s, a, b, valleys)
        assert [g["i"] for g in got] == valleys
        for g in got:
            want = plain_judgement(t.tolist(), v.tolist(), a, b, g["i"], 400.0)
            assert g.pop("reasons") == want.pop("reasons")
            assert g == pytest.approx(want, abs=1e-6)


def test_range_maxima():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        v = rng.integers(0, 9, n).astype(float)
        high = hybrid.RangeMax(v)
        for a in range(n):
            b = np.arange(a, n)
            assert high.of(a, b).tolist() == [v[a : x + 1].max() for x in b]
        i, level = np.arange(n), np.array(rng.integers(0, 9, n), float)
        for x, y in zip(i, high.left_of(i, 0, level)):
            assert y == max([j + 1 for j in range(x) if v[j] > level[x]], default=0)
        for x, y in zip(i, high.right_of(i, n - 1, level)):
            assert y == min([j - 1 for j in range(x + 1, n) if v[j] > level[x]], default=n - 1)


def test_many_valleys_cost_no_square():
    def seconds(n):
        t = np.arange(n) / 10
        v = 500 + 50 * np.sin(np.arange(n) * 1.3) + np.arange(n) % 5
        s, began = hybrid._Signal(t, v, v, 10.0, 5.0), time.process_time()
        assert len(hybrid.judge(s, 0, n - 1, hybrid._valleys(s, 0, n - 1))) > n / 20
        return time.process_time() - began

    seconds(10_000)
    assert seconds(160_000) < 40 * max(seconds(20_000), 0.02)  # 8 times the rows; their square would be 64 times


def test_rows_of_every_kind(spark):
    held = [30.0] * 20 + bumps([900 + 40 * (i % 3) for i in range(6)], 320, 4.0) + [30.0] * 20
    # opens above the threshold, dips, and only then rises for good
    late = [160.0] * 12 + bumps(HEIGHTS[:3], 70, 2.4, 1.8) + [70.0] * 20
    rows = analysis.smoothed(frame(spark, {"held": held, "late": late, "flat": [3.0] * 40, "short": [1.0, 9.0]}))
    limits = analysis.full_thresholds(rows)
    regions = detect.detect(rows, limits)
    out = hybrid.detect(rows, limits, regions).collect()
    of = lambda k, kind: sorted((r for r in out if r.recording_id == k and r.kind == kind), key=lambda r: r.item)
    assert {r.recording_id for r in out} == {"held", "late"} and {r.kind for r in out} <= set(hybrid.KINDS)
    (region,), (cycle,) = of("held", "region"), of("held", "cycle")
    reps, candidates = of("held", "rep"), of("held", "candidate")
    assert len(reps) == 6 and region.peak_value == max(held) and region.start_time == reps[0].start_time and region.end_time == reps[-1].end_time
    assert [r.item for r in reps] == list(range(1, 7))
    assert cycle.cycle_duration == pytest.approx(4.0, abs=0.3) and cycle.kept_cuts == [r.end_time for r in reps[:-1]] and set(cycle.kept_cuts) <= set(cycle.cuts)
    kept = [c for c in candidates if c.accepted]
    assert sorted(c.start_time for c in kept) == cycle.kept_cuts and all(not c.reasons for c in kept) and all(c.reasons for c in candidates if not c.accepted)
    assert all(c.rebound_height == pytest.approx(c.right_peak - c.value) and c.center_gap == pytest.approx(c.right_center - c.left_center) for c in candidates)
    assert [(q.start_time, q.end_time) for q in of("held", "quality") if q.accepted] == [(r.start_time, r.end_time) for r in reps]
    (moved,) = of("late", "adjustment")
    assert moved.start_time == 0.0 and of("late", "rep")[0].start_time == moved.end_time and moved.initial_peak < moved.substantial_level


def test_regions_are_groups_of_their_own(spark):
    apart = [70.0] * 20 + bumps(HEIGHTS, 70, 2.4, 1.8) + [70.0] * 20
    rows = analysis.smoothed(frame(spark, {"a": apart}))
    limits = analysis.full_thresholds(rows)
    regions = detect.detect(rows, limits)
    got = hybrid.detect(rows, limits, regions)
    assert got.filter("kind = 'region'").count() == regions.count() == len(HEIGHTS)
    spans = regions.orderBy("rep_no").collect()
    assert [(r.region_no, r.start_time, r.end_time) for r in got.filter("kind = 'rep'").orderBy("item").collect()] == [(s.rep_no, s.start_time, s.end_time) for s in spans]
    assert intervals.held_points(rows, regions).count() < rows.count()


def test_regions_of_a_chunk_are_split_as_one_by_one():
    parts, sizes = [random_signal(seed, n) for seed, n in enumerate((3, 40, 260, 1, 700, 90))], []
    first = np.cumsum([0] + [len(t) for t, _ in parts])[:-1]
    t, v = (np.concatenate(x) for x in zip(*parts))
    n = len(parts)
    rows, c = hybrid.split_regions(t, v, v, first, np.full(n, 400.0), np.full(n, 300.0), np.full(n, 1500.0), np.zeros(n, bool), features=True)
    for k, (own_t, own_v) in enumerate(parts):
        alone = hybrid.split_region(own_t, own_v, own_v, 400.0, 300.0, 1500.0, features=True)
        assert [r for r in alone if r["kind"] != "candidate"] == [{x: y for x, y in r.items() if x != "region"} for r in rows if r["region"] == k]
        found = [r for r in alone if r["kind"] == "candidate"]
        sizes.append(len(found))
        for name in ("start_time", "score", "reasons", *hybrid.FEATURES):
            got = [x for x, r in zip(c[name], c["region"]) if r == k]
            assert got == [r[name] for r in found] or got == pytest.approx([r[name] for r in found], rel=1e-12)
    assert sizes[0] == sizes[3] == 0 and sum(sizes) == len(c["region"]) > 100


@pytest.mark.parametrize("chunk", [1, 40, 10**6])
def test_a_task_takes_whole_regions(chunk, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(hybrid, "CHUNK_ROWS", chunk)
    key = [("a", 1)] * 30 + [("a", 2)] * 5 + [("b", 2)] * 70 + [(None, 2)] * 3 + [(None, 3)] * 9
    rows = pa.table({"recording_id": [k for k, _ in key], "region_no": [r for _, r in key], "seq": range(len(key))})
    tables = list(hybrid._whole_regions(iter(rows.to_batches(max_chunksize=7))))
    assert pa.concat_tables([x for x, _ in tables]).equals(rows)
    runs = [x.slice(a, b - a).to_pylist() for x, first in tables for a, b in zip(first, [*first[1:], x.num_rows])]
    assert [len(r) for r in runs] == [30, 5, 70, 3, 9] and all(len({(x["recording_id"], x["region_no"]) for x in r}) == 1 for r in runs)


def test_a_chunk_costs_less_than_its_regions():
    t = np.arange(50) / 10
    v = 500 + 300 * np.sin(t * 2) + 50 * np.sin(t * 17)
    n, began = 2000, time.process_time()
    hybrid.split_regions(np.tile(t, n), np.tile(v, n), np.tile(v, n), np.arange(n) * 50, np.full(n, 10.0), np.full(n, 5.0), np.full(n, 900.0), np.zeros(n, bool), kinds=("candidate",))
    chunk, began = time.process_time() - began, time.process_time()
    for _ in range(n):
        hybrid.split_region(t, v, v, 10.0, 5.0, 900.0)
    assert 3 * chunk < time.process_time() - began


def test_regions_found_on_the_way_are_those_of_the_threshold_detector(spark):
    weak = [70.0] * 20 + bumps((420,), 70, 0.8, 1.8) + bumps(HEIGHTS, 70, 3.2, 1.8) + [70.0] * 20
    made = {"apart": [70.0] * 20 + bumps(HEIGHTS, 70, 2.4, 1.8) + [70.0] * 20, "weak": weak, "held": [30.0] * 20 + bumps((900, 940, 980, 900), 320, 4.0) + [30.0] * 20, "flat": [5.0] * 50, "short": [1.0, 9.0]}
    rows = smoothing.with_thresholds(analysis.smoothed(frame(spark, made)))
    regions = detect.detect(rows)
    want = sorted(hybrid.detect(rows, None, regions).collect(), key=str)
    got = hybrid.detect(rows, None, kinds=(*hybrid.KINDS, hybrid.THRESHOLD)).collect()
    assert sorted((r for r in got if r.kind != hybrid.THRESHOLD), key=str) == want and {r.recording_id for r in want} == {"apart", "weak", "held"}
    spans = sorted((r.recording_id, r.region_no, r.start_time, r.end_time) for r in got if r.kind == hybrid.THRESHOLD)
    assert spans == sorted(tuple(r) for r in regions.collect())
    assert len([s for s in spans if s[0] == "weak"]) < detect.threshold_reps(rows, None).filter("recording_id = 'weak'").count()


def test_thresholds_of_a_shorter_prefix(spark):
    made = {"tail": [70.0] * 20 + bumps(HEIGHTS, 70, 2.4, 1.8) + [20.0] * 200, "whole": [70.0] * 20 + bumps((500,), 70, 2.4, 0.0), "flat": [5.0] * 50}
    signal = analysis.smoothed(frame(spark, made))
    prefix = smoothing.active_prefix(signal)
    n = {r.recording_id: r["count"] for r in prefix.groupBy("recording_id").count().collect()}
    want = {r.recording_id: (r.start_threshold, r.end_threshold) for r in smoothing.thresholds(prefix).collect() if n[r.recording_id] < len(made[r.recording_id])}
    got = smoothing.with_prefix_thresholds(signal).collect()
    assert "tail" in want and {r.recording_id: (r.start_threshold, r.end_threshold) for r in got} == want
    assert len(got) == sum(len(made[k]) for k in want)
