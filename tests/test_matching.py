"""Candidates against boundaries, compared with taking all pairs in order."""

import random

import pytest

from tidewater.operators import matching


def in_order(candidates, boundaries, tolerance):
    """Nearest first over all pairs of a session."""
    pairs = []
    for ci, t in candidates:
        for bi, lo, hi, mid in boundaries:
            error = max(0.0, lo - t, t - hi)
            if round(error, 6) <= tolerance:
                pairs.append((round(error, 6), round(abs(t - mid), 6), t, mid, ci, bi))
    taken, out = set(), []
    for error, _, _, _, ci, bi in sorted(pairs):
        if ("c", ci) not in taken and ("b", bi) not in taken:
            taken |= {("c", ci), ("b", bi)}
            out.append((ci, bi, error))
    return sorted(out)


@pytest.mark.parametrize("tolerance", [0.25, 1.0])
def test_components_give_what_one_pass_gives(spark, tolerance):
    rng = random.Random(11)
    sessions = {}
    for k in range(25):
        lows = sorted(rng.randint(0, 80) / 4 for _ in range(rng.randint(0, 14)))
        spans = [(lo, lo + rng.choice([0.0, 0.0, 0.25, 0.5, 2.0])) for lo in lows]
        boundaries = [(i + 1, lo, hi, (lo + hi) / 2) for i, (lo, hi) in enumerate(spans)]
        candidates = [(i + 1, rng.randint(0, 170) / 8) for i in range(rng.randint(0, 40))]
        sessions[k] = candidates, boundaries
    c = spark.createDataFrame([(k, i, t) for k, (cs, _) in sessions.items() for i, t in cs], "session_id long, cand_index long, time_s double")
    b = spark.createDataFrame([(k, *x) for k, (_, bs) in sessions.items() for x in bs], "session_id long, boundary_index long, lo double, hi double, boundary_time double")
    got = {k: [] for k in sessions}
    for r in matching.match_candidates(c, b, tolerance).collect():
        got[r.session_id].append((r.cand_index, r.boundary_index, r.error))
    assert {k: sorted(v) for k, v in got.items()} == {k: in_order(cs, bs, tolerance) for k, (cs, bs) in sessions.items()}
    sizes = [r["count"] for r in matching.reach_components(b, 0.25).groupBy("session_id", "component").count().collect()]
    assert max(sizes) < max(len(bs) for _, bs in sessions.values()) and sum(sizes) == b.count()


def test_ends_of_the_reach_count(spark):
    b = spark.createDataFrame([("s", 1, 9.1, 9.3, 9.2)], "session_id string, boundary_index long, lo double, hi double, boundary_time double")
    c = spark.createDataFrame([("s", 1, 9.1 - 0.25), ("s", 2, 8.849), ("s", 3, 9.55), ("t", 1, 9.2)], "session_id string, cand_index long, time_s double")
    assert [(r.cand_index, r.error) for r in matching.match_candidates(c, b).collect()] == [(1, 0.25)]
    assert [(r.cand_index, r.error) for r in matching.match_candidates(c.filter("cand_index = 3"), b).collect()] == [(3, 0.25)]
