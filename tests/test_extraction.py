"""Clips out of chunks, against whole recordings."""

import collections

import numpy as np
import pytest

from eventide.operators import extraction, scans

RATE = 400


def plain_clips(raw, stem):
    """The clips of a whole stem: begin, end and samples."""
    filter_ = extraction.response(RATE)
    mean = RATE // 100
    envelope = lambda x: np.sqrt(np.convolve(np.convolve(x, filter_)[: len(x)] ** 2, np.full(mean, 1 / mean)))
    e = envelope(raw)[RATE // 10 : -(RATE // 10)]
    if not len(e):
        return []
    on = (envelope(stem) - e.min()) / (e.max() - e.min() + 1e-6) > 0.25
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
    runs = []
    for b, t in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if runs and b - runs[-1][1] <= int(0.1 * RATE) - 2:
            runs[-1][1] = t
        else:
            runs.append([b, t])
    out = []
    for b, t in runs:
        if b > 0 and t < len(on) and t - b >= int(0.03 * RATE):
            b, t, ramp = max(0, b - RATE // 20), t + RATE // 20, RATE // 20
            x = stem[max(0, b - ramp) : t + ramp].copy()
            i = np.arange(len(x))
            out.append((b, t, x * np.minimum(1, i / (ramp - 1)) * np.minimum(1, i[::-1] / (ramp - 1))))
    return out


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(8)
    out = {}
    for k, n in (("a", 6000), ("b", 3001), ("short", 75), ("one", 1), ("quiet", 2000)):
        x = rng.normal(size=n) * 0.01
        for at in range(300, n - 200, 700):
            x[at : at + int(rng.integers(8, 300))] *= 100
        if k == "quiet":
            x[:] = 0
        out[k] = (x, {1: x, 2: np.where(np.arange(n) % 1400 < 700, x, x * 0.01)})
    return out


@pytest.mark.parametrize("size", [7, 64, 500, 10_000])
def test_clips_do_not_depend_on_chunks(spark, recordings, monkeypatch, size):
    monkeypatch.setattr(scans, "LONG", 5)
    monkeypatch.setattr(scans, "SLICES", 4)
    cut = lambda x: [(i // size, x[i : i + size].tolist()) for i in range(0, len(x), size)]
    raw = spark.createDataFrame([(k, c, x) for k, (r, _) in recordings.items() for c, x in cut(r)], "key string, chunk long, samples array<double>").repartition(3)
    stems = spark.createDataFrame([(k, s, c, x) for k, (_, own) in recordings.items() for s, r in own.items() for c, x in cut(r)], "key string, source int, chunk long, samples array<double>").repartition(3)
    found = extraction.clips(raw, stems, "key", "source", "samples", size, RATE)
    got = collections.defaultdict(list)
    for r in extraction.clip_samples(stems, found, "key", "source", "samples", size, RATE).collect():
        got[r["key"], r["source"]].append((r["begin"], r["end"], np.array(r["samples"])))
    total = 0
    for k, (r, own) in recordings.items():
        for s, x in own.items():
            want = plain_clips(r, x)
            assert [(b, e) for b, e, _ in sorted(got[k, s], key=lambda c: c[0])] == [(b, e) for b, e, _ in want]
            assert all(np.allclose(p[2], q[2]) for p, q in zip(sorted(got[k, s], key=lambda c: c[0]), want, strict=True))
            total += len(want)
    assert total > 10


def test_no_recordings(spark):
    raw = spark.createDataFrame([], "key string, chunk long, samples array<double>")
    stems = spark.createDataFrame([], "key string, source int, chunk long, samples array<double>")
    assert extraction.clips(raw, stems, "key", "source", "samples", 64, RATE).count() == 0


def test_filter_of_blocks():
    rng = np.random.default_rng(1)
    x, h = rng.normal(size=30_000), rng.normal(size=300)
    whole = np.convolve(x, h)[: len(x)]
    for at, end, keep in ((0, 30_000, 0), (0, 10, 3), (5000, 17_000, 40), (200, 201, 5)):
        before = x[max(0, at - 299 - keep) : at]
        got = extraction.overlap_save(before, x[at:end], h, keep)
        assert np.allclose(got, np.concatenate([np.zeros(max(0, keep - at)), whole[max(0, at - keep) : end]]))
