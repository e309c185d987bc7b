"""Recordings in chunks at another rate, by a windowed sinc in polyphase form."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.templates import with_following

#: Zero crossings of the sinc on each side, the part of the lower of both bands that passes, and the window's shape: what
#: lies above the band is damped by 60 dB and more.
ZEROS, PASSED, BETA = 32, 0.9, 7.0


def phases(up: int, down: int) -> np.ndarray:
    """The taps of each of `up` phases. Output m stands at m * down / up: of phase r = m * down % up, at the whole place q
    before that, it is the sum of x[q - j] * taps[r][j + reach] for j from -reach to reach. Each phase sums up to 1, so a
    constant stays as it is."""
    band = min(1.0, up / down)
    reach = int(np.ceil(ZEROS / band))
    t = np.arange(up)[:, None] / up + np.arange(-reach, reach + 1)
    inside = np.clip(1 - (t / (reach + 1)) ** 2, 0, None)
    taps = np.sinc(band * PASSED * t) * np.i0(BETA * np.sqrt(inside)) * (inside > 0)
    return taps / taps.sum(1, keepdims=True)


def resampled(chunks: DataFrame, by: str, samples: str, size: int, rate: int, target: int) -> DataFrame:
    """by, chunk, first (number of the first sample at the new rate) and samples of recordings at another rate.

    chunks: by, chunk (from 0) and samples, `size` of them but for the last chunk. Output chunks stand for the same times as
    the input's, so their lengths differ by one; empty ones are left out. What stands outside a recording is silence. n
    samples become ceil(n * target / rate). The result doesn't depend on the length of chunks.
    """
    ratio = Fraction(target, rate)
    up, down = ratio.numerator, ratio.denominator
    taps = phases(up, down)
    reach = taps.shape[1] // 2
    n = chunks.groupBy(by).agg(F.max(F.col("chunk") * size + F.size(samples)).alias("n"))
    wide = with_following(chunks.select(by, "chunk", F.col(samples).alias("frames")), by, size, reach, reach).join(n, by)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, chunk, x, lead, n in part.itertuples(index=False):
                end = min((chunk + 1) * size, n)
                m = np.arange(-(-chunk * size * up // down), -(-end * up // down))
                if not len(m):
                    continue
                x = np.concatenate([np.zeros(reach), np.asarray(x, float), np.zeros(reach)])
                q, r = np.divmod(m * down, up)
                first = q - (chunk * size - lead)  # place of x[q - reach] in the padded samples
                windows = np.lib.stride_tricks.sliding_window_view(x, 2 * reach + 1)
                out = np.empty(len(m))
                for phase in range(up):
                    own = np.flatnonzero(r == phase)
                    out[own] = windows[first[own]] @ taps[phase, ::-1]
                rows.append((key, chunk, m[0], out))
            yield pd.DataFrame(rows, columns=[by, "chunk", "first", "samples"])

    kind = chunks.schema[by].dataType.simpleString()
    return wide.select(by, "chunk", "frames", "lead", "n").mapInPandas(run, f"{by} {kind}, chunk long, first long, samples array<double>")
