"""Signals in bounded chunks: array functions in numpy, called in Arrow batches."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.intervals import merged


def high_pass(x: np.ndarray, rate: int, cutoff: float = 25.0, order: int = 10) -> np.ndarray:
    """A digital Butterworth filter (bilinear transform, so with its phase), applied to the spectrum of the signal with a
    second of silence behind it, by when its response has died away."""
    if not len(x):
        return np.zeros(0)
    n = len(x) + rate
    k = np.arange(order)
    poles = 2 * rate * np.tan(np.pi * cutoff / rate) / np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    s = 2j * rate * np.tan(np.pi * np.minimum(np.fft.rfftfreq(n), 0.5 - 1e-9))
    return np.fft.irfft(np.fft.rfft(x, n) * np.prod(s[:, None] / (s[:, None] - poles), axis=1), n)[: len(x)]


def envelope(x: np.ndarray, rate: int, length: int) -> np.ndarray:
    """Root of the moving mean power of the high-passed signal; len(x) + length - 1 values."""
    if not len(x):
        return np.zeros(0)
    power = np.convolve(high_pass(x, rate) ** 2, np.full(length, 1 / length))
    return np.sqrt(np.maximum(power, 0))


def spectrogram(x: np.ndarray, size: int = 512, hop: int = 256) -> np.ndarray:
    """Magnitudes, frequency by frame, less the median of each bin and then of each frame, both taken from the original."""
    n = max(0, 1 + (len(x) - size) // hop)
    frames = np.stack([x[i * hop : i * hop + size] for i in range(n)]) if n else np.zeros((0, size))
    s = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)).T
    return s - np.median(s, axis=1, keepdims=True) - np.median(s, axis=0, keepdims=True) if n else s


def correlation(s: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation along time of a spectrogram with a template of the same bins."""
    w = template.shape[1]
    if s.shape[1] < w or not w:
        return np.zeros(0)
    t = template - template.mean()
    windows = np.lib.stride_tricks.sliding_window_view(s, w, axis=1).transpose(1, 0, 2)
    centred = windows - windows.mean((1, 2), keepdims=True)
    size = np.sqrt((centred**2).sum((1, 2)) * (t**2).sum())
    return np.divide((centred * t).sum((1, 2)), size, out=np.zeros(len(centred)), where=size > 0)


def shifted_correlation(s: np.ndarray, template: np.ndarray, shift: int = 2) -> np.ndarray:
    """The best correlation at each frame with the inner bins of a template, moved by up to `shift` bins each way."""
    inner = template[shift : len(template) - shift]
    return np.max([correlation(s[k : k + len(inner)], inner) for k in range(2 * shift + 1)], axis=0)


def peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Places of local maxima of at least height, the higher ones first of any two that are closer than distance."""
    if len(x) < 3:
        return np.zeros(0, int)
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)) + 1
    kept: list[int] = []
    for i in at[np.argsort(-x[at], kind="stable")]:
        if all(abs(i - k) >= distance for k in kept):
            kept.append(int(i))
    return np.array(sorted(kept), int)


def peak_frequency(x: np.ndarray, rate: int, size: int = 512, hop: int = 256, skip: int = 3) -> float:
    """Mean over frames of the frequency of the largest bin, the lowest ones left out."""
    n = 1 + (len(x) - size) // hop
    if n < 1:
        return float("nan")
    s = np.abs(np.fft.rfft(np.stack([x[i * hop : i * hop + size] for i in range(n)]) * np.hanning(size), axis=1))
    return float(np.fft.rfftfreq(size, 1 / rate)[skip + s[:, skip:].argmax(1)].mean())


def flatness_db(x: np.ndarray, size: int = 512) -> float:
    """Ratio of geometric and arithmetic mean of the power spectrum, in dB."""
    p = np.abs(np.fft.rfft(x[:size])) ** 2 + 1e-10
    return float(10 * np.log10(np.exp(np.log(p).mean()) / p.mean()))


def mean_flatness_db(x: np.ndarray, size: int = 2048, hop: int = 512) -> float:
    """Mean over frames of the ratio of geometric and arithmetic mean of the power spectrum, in dB."""
    n = 1 + (len(x) - size) // hop
    if n < 1:
        return float("nan")
    p = np.maximum(np.abs(np.fft.rfft(np.stack([x[i * hop : i * hop + size] for i in range(n)]) * np.hanning(size), axis=1)) ** 2, 1e-10)
    return float((10 * np.log10(np.exp(np.log(p).mean(1)) / p.mean(1))).mean())


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping frames; the last one is padded with zeros."""
    n = max(1, -(-max(0, len(x) - size) // hop) + 1)
    padded = np.concatenate([x, np.zeros(max(0, (n - 1) * hop + size - len(x)))])
    return np.stack([padded[i * hop : i * hop + size] for i in range(n)])


def overlap_added(frames: np.ndarray, hop: int, length: int) -> np.ndarray:
    """Frames added up and divided by how many cover a sample: the inverse of framed()."""
    total, cover = np.zeros((len(frames) - 1) * hop + frames.shape[1]), np.zeros((len(frames) - 1) * hop + frames.shape[1])
    for i, f in enumerate(frames):
        total[i * hop : i * hop + len(f)] += f
        cover[i * hop : i * hop + len(f)] += 1
    return (total / np.maximum(cover, 1))[:length]


def permutation(before: np.ndarray, after: np.ndarray) -> tuple[int, ...]:
    """The order of the sources of a block (rows: sources, columns: the samples it shares with the block before) that
    agrees best with that block's, by the sum of their correlations; the first such order."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    alike = unit(before) @ unit(after).T
    orders = list(itertools.permutations(range(len(after))))
    return orders[int(np.argmax([alike[np.arange(len(before)), list(o)].sum() for o in orders]))]


def band_energy(x: np.ndarray, rate: int, low: float, high: float, size: int = 2048, hop: int = 320, whole: bool = True) -> np.ndarray:
    """Power between two frequencies in each frame. whole: frames are windowed and centred on their hop, and the signal is
    mirrored at its ends; else they are plain stretches of the signal."""
    window = np.ones(size)
    if whole:
        x, window = np.pad(x, size // 2, "reflect"), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    n = 1 + (len(x) - size) // hop
    if n < 1:
        return np.zeros(0)
    frames = np.stack([x[i * hop : i * hop + size] for i in range(n)]) * window
    f = np.fft.rfftfreq(size, 1 / rate)
    return (np.abs(np.fft.rfft(frames, axis=1)) ** 2)[:, (f >= low) & (f <= high)].sum(1)


def band_snr(event: np.ndarray, background: np.ndarray, rate: int, low: float, high: float, size: int = 2048, hop: int = 320, whole: bool = True) -> float:
    """Mean power of an event in a band over the noise floor there (the fifth part of the background's frames that is
    lowest ends at it), in dB; 50 or -50 where either is 0, and 0 where both are."""
    e, b = (band_energy(x, rate, low, high, size, hop, whole) for x in (event, background))
    if not len(e) or not len(b):
        return float("nan")
    with np.errstate(divide="ignore", invalid="ignore"):
        db = 10 * (np.log10(e.mean()) - np.log10(np.quantile(b, 0.2)))
    return float(np.nan_to_num(db, posinf=50, neginf=-50))


def mean_mel(x: np.ndarray, rate: int, n_mels: int = 64, size: int = 1024, hop: int = 512) -> np.ndarray:
    """Mean mel power spectrum of a signal (the events of a recording one after another)."""
    frames = framed(x, size, hop) * np.hanning(size)
    return (mel_bank(size // 2 + 1, rate, n_mels) @ (np.abs(np.fft.rfft(frames, axis=1)) ** 2).T).mean(1)


def mel_bank(bins: int, rate: int, n_mels: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular filters on the mel scale from low to high (half the rate), a row each."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    centres = 700 * (10 ** (np.linspace(mel(low), mel(rate / 2 if high is None else high), n_mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, bins)
    up = (f - centres[:-2, None]) / np.diff(centres)[:-1, None]
    down = (centres[2:, None] - f) / np.diff(centres)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def mel_db(x: np.ndarray, rate: int, n_mels: int = 64, size: int = 1024, hop: int = 160) -> np.ndarray:
    """Mel power in dB, scaled to [-1, 1] between its least and largest value."""
    frames = framed(x, size, hop) * np.hanning(size)
    power = mel_bank(size // 2 + 1, rate, n_mels) @ (np.abs(np.fft.rfft(frames, axis=1)) ** 2).T
    db = 10 * np.log10(np.maximum(power, 1e-10))
    low, high = db.min(), db.max()
    return (db - low) / (high - low) * 2 - 1 if high > low else np.zeros_like(db)


def by_signal(rows: DataFrame, keys: list[str], samples: str, make: Callable[[np.ndarray], float], name: str) -> DataFrame:
    """keys and one number for every row's signal."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[keys].assign(**{name: [float(make(np.asarray(x, float))) for x in part[samples]]})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, samples).mapInPandas(run, f"{kinds}, {name} double")


def above(rows: DataFrame, keys: list[str], samples: str, rate: int, length: int, share: float = 0.25) -> DataFrame:
    """keys, frame and on: where the envelope, scaled by the range of the raw signal's, is above a share."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row, x in zip(part[keys].itertuples(index=False), part[samples], strict=True):
                e = envelope(np.asarray(x, float), rate, length)
                span = e.max() - e.min() if len(e) else 0.0
                on = (e - e.min()) / span > share if span > 0 else np.zeros(len(e), bool)
                yield pd.DataFrame({**{k: [v] * len(e) for k, v in zip(keys, row, strict=True)}, "frame": np.arange(len(e)), "on": on})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, samples).mapInPandas(run, f"{kinds}, frame long, on boolean")


def template_detections(rows: DataFrame, key: str, samples: str, templates: list[np.ndarray], threshold: float, distance: int | None = None, shift: int = 0) -> DataFrame:
    """key, frame, frames and score of the peaks of the correlation with any of a few templates (spectrograms), each with
    the number of frames of its template (the longest, if several peak at a frame). Without a distance, peaks of a
    template are as far apart as it is long."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, x in zip(part[key], part[samples], strict=True):
                s = spectrogram(np.asarray(x, float))
                for t in templates:
                    c = shifted_correlation(s, t, shift) if shift else correlation(s, t)
                    at = peaks(c, threshold, distance or t.shape[1])
                    yield pd.DataFrame({key: [k] * len(at), "frame": at, "frames": t.shape[1], "score": c[at]})

    found = rows.select(key, samples).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, frame long, frames long, score double")
    return found.groupBy(key, "frame").agg(F.max("frames").alias("frames"), F.max("score").alias("score"))


def painted_segments(detections: DataFrame, key: str, rate: int, hop: int, first: int = 0) -> DataFrame:
    """key, begin_s and end_s of the stretches that detections (frame, frames) of any template paint: a detection paints
    all frames of its template but the last. first is the frame of the recording that frame 0 is. Times are those of the
    frame before a stretch and of its last one."""
    spans = detections.select(key, (F.col("frame") + first).alias("b"), (F.col("frame") + first + F.col("frames") - 1).alias("e"))
    at = lambda c: F.greatest(F.col(c) - 1, F.lit(0)) * float(hop) / rate
    return merged(spans, [key], "b", "e").select(key, at("b").alias("begin_s"), at("e").alias("end_s"))


def adaptive_height(templates: list[np.ndarray]) -> list[float]:
    """For each template, the largest correlation with any other that is at least as long; 0 if there is none."""
    return [max((correlation(o, t).max(initial=0.0) for j, o in enumerate(templates) if j != i and o.shape[1] >= t.shape[1]), default=0.0) for i, t in enumerate(templates)]
