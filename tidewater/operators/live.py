"""The detectors on the samples of one set that is still being recorded, held in arrays.

Thresholds follow the lowest tenth and the peak of what has been seen, so every
reading may change any repetition; a set is therefore segmented anew as it grows.
For tables use :mod:`~tidewater.operators.detect` and
:mod:`~tidewater.operators.hybrid`, which do many recordings at once.
"""

from __future__ import annotations

import numpy as np

from .detect import MIN_DURATION_S, MIN_GAP_S, TRANSIENT
from .hybrid import split_region
from .smoothing import END_FRACTION, LOW_PERCENT, START_FRACTION, WINDOW


def smooth(raw: np.ndarray) -> np.ndarray:
    """The centred average of :func:`~tidewater.operators.smoothing.centered_average`."""
    n = len(raw)
    half, sums = min(WINDOW, n) // 2, np.concatenate([[0.0], np.cumsum(raw)])
    i = np.arange(n)
    a, b = np.maximum(0, i - half), np.minimum(n, i + half + 1)
    return np.round((sums[b] - sums[a]) / (b - a), 9)


def levels(v: np.ndarray) -> tuple[float, float]:
    """Start and end threshold of a smoothed signal."""
    k = max(1, len(v) * LOW_PERCENT // 100)
    low, high = round(float(np.partition(v, k - 1)[:k].mean()), 9), float(v.max())
    return round(low + START_FRACTION * (high - low), 9), round(low + END_FRACTION * (high - low), 9)


def regions(t: np.ndarray, v: np.ndarray, start: float, end: float) -> list[tuple[int, int]]:
    """First and last sample of each repetition of the threshold detector, without an opening transient.

    Only the samples where the signal rises over one threshold or falls to the
    other can open or close a repetition; the rest is skipped.
    """
    before = v[:-1]
    up = np.concatenate([[v[0] >= start], (before <= start) & (v[1:] > start)])
    low = v <= end
    events = np.flatnonzero(up | low | (np.arange(len(v)) == len(v) - 1))
    found, opened, quiet = [], None, -np.inf
    for i in events.tolist():
        if opened is None and up[i] and round(float(t[i]), 6) >= round(quiet, 6):
            opened = i
        if opened is not None and (low[i] or i == len(v) - 1):
            if round(float(t[i] - t[opened]), 6) >= MIN_DURATION_S:
                found.append((opened, i))
                quiet = float(t[i]) + MIN_GAP_S
            opened = None
    if len(found) < 2:
        return found
    facts = []
    for a, b in found:
        over = v[a : b + 1] - start
        facts.append((t[b] - t[a], np.maximum(0, over).sum() * ((t[b] - t[a]) / (b - a) if b > a else 0), over.max()))
    first, usual = facts[0], np.median(np.array(facts[1:]), axis=0)
    weak = all(u > 0 and f < u * TRANSIENT[c] for f, u, c in zip(first, usual, ("duration", "area", "peak_excess")))
    return found[1:] if weak else found


def repetitions(t: np.ndarray, raw: np.ndarray) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
    """Start and end of each repetition so far, by the threshold and by the valley detector; none in fewer than three samples or a flat signal."""
    if len(raw) < 3:
        return [], []
    v = smooth(raw)
    if v.max() <= v.min():
        return [], []
    start, end = levels(v)
    whole = regions(t, v, start, end)
    valleys = [r for a, b in whole for r in split_region(t[a : b + 1], raw[a : b + 1], v[a : b + 1], start, end, float(v.max()), a == 0) if r["kind"] == "rep"]
    return [(float(t[a]), float(t[b])) for a, b in whole], [(r["start_time"], r["end_time"]) for r in valleys]
