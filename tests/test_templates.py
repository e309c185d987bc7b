"""The template detector over chunks, against whole spectrograms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions.signal import correlation, shifted_correlation
from eventide.operators import scans, templates


def plain_peaks(c, height, distance):
    at = [i for i in range(1, len(c) - 1) if c[i] > c[i - 1] and c[i] >= c[i + 1] and c[i] >= height]
    kept = []
    for i in sorted(at, key=lambda i: (-c[i], i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return sorted(kept)


def plain_segments(s, spans, rate, hop):
    """Of a spectrogram (frames by bins): the stretches that its templates paint."""
    own = [s[a:b, 2:-2].T for a, b in spans]
    pairs = [correlation(own[j], own[i]).max() for i in range(len(own)) for j in range(len(own)) if i != j and own[j].shape[1] >= own[i].shape[1]]
    if not pairs:
        return []
    start, painted = max(b for _, b in spans), np.zeros(len(s) + 1, bool)
    for a, b in spans:
        c = shifted_correlation(s[start:].T, s[a:b].T) if len(s) - start >= b - a else np.zeros(0)
        for i in plain_peaks(c, max(pairs), b - a):
            painted[start + i : start + i + b - a - 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], painted.astype(int), [0]])))
    return [(max(x - 1, 0) * hop / rate, (y - 1) * hop / rate) for x, y in zip(edges[::2], edges[1::2], strict=True)]


@pytest.mark.parametrize("size", [3, 8, 200])
def test_detector_does_not_depend_on_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(scans, "LONG", 10)
    monkeypatch.setattr(scans, "SLICES", 3)
    rng = np.random.default_rng(4)
    made, spans = {}, {}
    for k, n in (("a", 150), ("b", 90), ("one", 60), ("short", 30)):
        s = rng.normal(size=(n, 12))
        call = rng.normal(size=(6, 12)) * 2
        for at in range(2, n - 6, 13):
            s[at : at + 6] += np.roll(call, int(rng.integers(-2, 3)), 1) if at > 30 else call
        s[:30] += 2 * rng.normal(size=s[:30].shape)  # so that the supports are less alike than what they find
        made[k] = s
        spans[k] = [(2, 8)] if k == "one" else [(2, 8), (15, 20), (16, 21)]
    chunks = spark.createDataFrame([(k, i // size, s[i : i + size].tolist()) for k, s in made.items() for i in range(0, len(s), size)], "k string, chunk long, frames array<array<double>>").repartition(4)
    supports = spark.createDataFrame([(k, e, a, b) for k, own in spans.items() for e, (a, b) in enumerate(own)], "k string, event int, first long, end long")
    got = {}
    for r in templates.detect(chunks, supports, "k", size, 100, 10, 6).collect():
        got.setdefault(r["k"], []).append((r["begin_s"], r["end_s"]))
    for k, s in made.items():
        want = plain_segments(s, spans[k], 100, 10)
        assert np.allclose(sorted(got.get(k, [])), want)
    assert len(got["a"]) > 3 and "one" not in got


def test_peaks_in_islands(spark, monkeypatch):
    monkeypatch.setattr(scans, "LONG", 50)
    monkeypatch.setattr(scans, "SLICES", 5)
    rng = np.random.default_rng(6)
    frames = {g: sorted(rng.choice(3000, 400, replace=False).tolist()) for g in "ab"}
    scores = {g: rng.integers(0, 30, 400).astype(float) for g in "ab"}
    df = spark.createDataFrame([(g, f, float(x)) for g in "ab" for f, x in zip(frames[g], scores[g], strict=True)], "g string, frame long, score double").repartition(3)
    got = templates.suppressed(df, ["g"], F.lit(9)).collect()
    for g in "ab":
        kept = []
        for f, _ in sorted(zip(frames[g], scores[g], strict=True), key=lambda p: (-p[1], p[0])):
            if all(abs(f - k) >= 9 for k in kept):
                kept.append(f)
        assert sorted(r["frame"] for r in got if r["g"] == g) == sorted(kept)
