"""Recordings at another rate."""

import numpy as np
import pytest

from eventide.operators import resampling


def whole(spark, x, size, rate, target):
    chunks = spark.createDataFrame([("r", i // size, x[i : i + size].tolist()) for i in range(0, len(x), size)], "k string, chunk long, samples array<double>").repartition(3)
    rows = resampling.resampled(chunks, "k", "samples", size, rate, target).orderBy("chunk").collect()
    out = np.concatenate([r["samples"] for r in rows])
    assert [r["first"] for r in rows] == np.cumsum([0, *(len(r["samples"]) for r in rows)])[:-1].tolist()
    return out


@pytest.mark.parametrize("rates", [(48, 16), (3, 2), (441, 480), (16, 48), (7, 7)])
def test_chunks_and_length(spark, rates):
    rng = np.random.default_rng(0)
    x, (rate, target) = rng.normal(size=1001), rates
    made = [whole(spark, x, size, rate, target) for size in (31, 400, 5000)]
    assert all(np.allclose(made[0], y) for y in made) and len(made[0]) == -(-1001 * target // rate)
    if rate == target:
        assert np.corrcoef(made[0], x)[0, 1] > 0.9


def test_tones(spark):
    """A tone above the new band is damped by 60 dB, one within it comes through with its phase."""
    t = np.arange(6000)
    for f, passes in ((1000, True), (3200, True), (4100, False), (7000, False), (15_000, False)):
        y = whole(spark, np.sin(2 * np.pi * f * t / 32_000), 900, 32_000, 8000)[100:-100]
        if passes:
            assert np.allclose(y, np.sin(2 * np.pi * f * np.arange(100, 1400) / 8000), atol=2e-3)
        else:
            assert 20 * np.log10(np.abs(y).max()) < -60
    assert np.allclose(whole(spark, np.ones(2000), 300, 32_000, 8000)[50:-50], 1)
    assert np.allclose(whole(spark, np.sin(2 * np.pi * t[:900] / 40), 100, 8000, 32_000)[400:-400], np.sin(2 * np.pi * np.arange(400, 3200) / 160), atol=2e-3)


def test_empty(spark):
    none = spark.createDataFrame([], "k string, chunk long, samples array<double>")
    assert resampling.resampled(none, "k", "samples", 64, 3, 2).count() == 0
