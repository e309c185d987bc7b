"""Spectra in chunks, against whole recordings."""

import numpy as np
import pytest

from eventide.functions.signal import envelope, mean_flatness_db, mel_bank
from eventide.operators import spectra


@pytest.mark.parametrize("size", [5, 64, 1000])
def test_spectra_do_not_depend_on_chunks(spark, size):
    rng = np.random.default_rng(0)
    made = {k: rng.normal(size=n) for k, n in (("a", 700), ("b", 128), ("c", 33), ("no", 16), ("d", 640))}
    chunks = spark.createDataFrame([(k, i // size, x[i : i + size].tolist()) for k, x in made.items() for i in range(0, len(x), size)], "k string, chunk long, samples array<double>").repartition(3)
    frames = spectra.mel_frames(chunks, "k", "samples", size, 640, 6, 32, 16, 20.0, 300.0)
    got = {}
    for r in frames.orderBy("k", "frame").collect():
        got.setdefault(r["k"], []).append(r["mel"])
    bank, taper = mel_bank(17, 640, 6, 20.0, 300.0), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    assert set(got) == set(made) - {"no"}
    for k, own in got.items():
        padded = np.pad(made[k], 16, "reflect")
        power = np.stack([np.abs(np.fft.rfft(padded[t * 16 : t * 16 + 32] * taper)) ** 2 for t in range(len(made[k]) // 16 + 1)])
        assert np.allclose(own, 10 * np.log10(power @ bank.T))
    for r in spectra.scaled(frames, "k", None).groupBy("k").agg({"mel": "max"}).collect():
        assert max(r[1]) <= 1
    for r in spectra.scaled(frames, "k", None).collect():
        db = np.array(got[r["k"]])
        low = max(db.min(), db.max() - 80)
        assert np.allclose(r["mel"], (np.maximum(db[r["frame"]], low) - low) / (db.max() - low) * 2 - 1)
    whole = {}
    for r in spectra.envelopes(chunks, ["k"], "samples", size, 640).orderBy("k", "chunk").collect():
        whole.setdefault(r["k"], []).extend(r["envelope"])
    assert all(np.allclose(whole[k], envelope(x, 640, 6), atol=1e-6) for k, x in made.items())


def test_silence(spark):
    chunks = spark.createDataFrame([("s", 0, [0.0] * 64)], "k string, chunk long, samples array<double>")
    frames = spectra.mel_frames(chunks, "k", "samples", 64, 640, 6, 32, 16, 20.0, 300.0)
    assert all(r["mel"] == [0.0] * 6 for r in spectra.scaled(frames, "k", None).collect())
    assert spectra.mel_frames(chunks.limit(0), "k", "samples", 64, 640, 6, 32, 16, 20.0, 300.0).count() == 0


def test_flatness():
    rng = np.random.default_rng(1)
    noise, tone = rng.normal(size=4096), np.sin(np.arange(4096))
    assert mean_flatness_db(noise) > -4 and mean_flatness_db(tone) < -20
