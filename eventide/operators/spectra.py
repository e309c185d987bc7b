"""Spectra of long recordings in chunks: frames take what they need from the chunks around, and what a recording is scaled
by is found over all of its chunks before any is scaled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.signal import mel_bank
from eventide.operators.extraction import chunk_envelope, enveloped, response
from eventide.operators.templates import with_following

#: Decibels that a recording's spectrum has below its largest value, and the ends of the scale of the model.
TOP_DB, SCALE = 80.0, (-79.6482, 50.6842)


def mel_frames(chunks: DataFrame, by: str, samples: str, size: int, rate: int, n_mels: int, window: int, hop: int, low: float, high: float) -> DataFrame:
    """by, frame and mel (decibels of mel power) of every frame of each recording.

    Frame t is centred on sample t * hop, and the recording is mirrored at its ends; there is a frame for every hop that
    begins in the recording or where it ends. chunks: by, chunk (from 0) and samples, `size` of them but for the last
    chunk. Recordings of no more than half a window have no frames.
    """
    half = window // 2
    n = chunks.groupBy(by).agg(F.max(F.col("chunk") * size + F.size(samples)).alias("n")).where(F.col("n") > half)
    wide = with_following(chunks.select(by, "chunk", F.col(samples).alias("frames")), by, size, half + 1, half + 1).join(n, by)
    taper, bank = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window), mel_bank(half + 1, rate, n_mels, low, high)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, chunk, x, lead, n in part.itertuples(index=False):
                last = (chunk + 1) * size >= n
                frames = np.arange(-(-chunk * size // hop), (n // hop if last else ((chunk + 1) * size - 1) // hop) + 1)
                if not len(frames):
                    continue
                at = np.abs(frames[:, None] * hop - half + np.arange(window))  # mirrored at 0
                at = np.where(at >= n, 2 * (n - 1) - at, at) - (chunk * size - lead)
                power = np.abs(np.fft.rfft(np.asarray(x, float)[at] * taper, axis=1)) ** 2
                yield pd.DataFrame({by: [key] * len(frames), "frame": frames, "mel": list(10 * np.log10(np.maximum(power @ bank.T, 1e-10)))})

    kind = chunks.schema[by].dataType.simpleString()
    return wide.select(by, "chunk", "frames", "lead", "n").mapInPandas(run, f"{by} {kind}, frame long, mel array<double>")


def scaled(frames: DataFrame, by: str, scale: tuple[float, float] | None = SCALE) -> DataFrame:
    """frames (by, frame, mel) with values raised to no more than TOP_DB below the largest of their recording, and brought
    from a scale to [-1, 1]; without one, from the least and largest value of the recording (0, if they are one)."""
    ends = frames.groupBy(by).agg(F.max(F.array_max("mel")).alias("_most"), F.min(F.array_min("mel")).alias("_least"))
    floor = F.col("_most") - TOP_DB
    low, high = (F.greatest("_least", floor), F.col("_most")) if scale is None else (F.lit(scale[0]), F.lit(scale[1]))
    value = F.transform("mel", lambda v: F.coalesce(F.try_divide(F.greatest(v, floor) - low, high - low) * 2 - 1, F.lit(0.0)))
    return frames.join(ends, by).select(by, "frame", value.alias("mel"))


def envelopes(chunks: DataFrame, by: list[str], samples: str, size: int, rate: int) -> DataFrame:
    """by, chunk and envelope (high-passed, root of the moving mean power) of each chunk; the last one of a recording has
    the mean's end too."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_ = response(rate)
        for part in parts:
            rows = [chunk_envelope(np.asarray(b, float), np.asarray(x, float), c * size + len(x) == n, rate, filter_) for c, x, b, n in zip(part["chunk"], part["samples"], part["before"], part["n"], strict=True)]
            yield part[[*by, "chunk"]].assign(envelope=rows)

    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in by)
    return enveloped(chunks, by, samples, size, rate).select(*by, "chunk", "samples", "before", "n").mapInPandas(run, f"{kinds}, chunk long, envelope array<double>")
