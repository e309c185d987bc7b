"""Clips out of long recordings that are stored in chunks of a fixed number of samples.

No task sees a whole recording. Each chunk gets the end of what stands before it (its halo), is filtered by overlap-save,
and gives the runs of its own samples; the extremes that envelopes are scaled by are those of all chunks; runs that chunk
borders cut are joined by a scan in slices; and clips take their samples from the chunks that they reach. The result is
the same for any length of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.signal import high_pass
from eventide.operators.runs import filled, long_enough

#: Seconds of the filter's response, of silence that may lie inside a clip, of the shortest clip, put on both sides of one,
#: and of its ramps; the parts of a second that a moving mean and each end of a recording take; the least share of the range.
RESPONSE_S, HOLE_S, LEAST_S, PAD_S, RAMP_S = 1.0, 0.1, 0.03, 0.05, 0.05
MEAN, EDGE, SHARE = 100, 10, 0.25


def with_halo(chunks: DataFrame, by: list[str], samples: str, size: int, halo: int) -> DataFrame:
    """by, chunk, samples, and before: the `halo` samples ahead of each chunk, or as many as there are.

    A chunk sends its end to the chunks that follow it, several if they are shorter than the halo."""
    i, to = F.col("chunk"), F.col("_to")
    sent = chunks.select(*by, "chunk", F.explode(F.sequence(i, i + -(-halo // size))).alias("_to"), F.col(samples).alias("_x"))
    first = F.greatest(F.lit(0).cast("long"), (to - i) * size - halo)
    part = F.when(to == i, F.col("_x")).otherwise(F.slice("_x", (first + 1).cast("int"), F.greatest(F.lit(0).cast("long"), F.size("_x") - first).cast("int")))
    met = sent.groupBy(*by, "_to").agg(F.sort_array(F.collect_list(F.struct("chunk", part.alias("x")))).alias("_parts"))
    own = F.element_at("_parts", -1)
    ahead = F.flatten(F.transform(F.slice("_parts", F.lit(1), F.size("_parts") - 1), lambda p: p["x"]))
    return met.where(own["chunk"] == to).select(*by, to.alias("chunk"), own["x"].alias("samples"), ahead.alias("before"))


def overlap_save(before: np.ndarray, x: np.ndarray, response: np.ndarray, keep: int) -> np.ndarray:
    """x, and the `keep` samples before it, after a filter of finite response; what stands ahead of `before` is silence.
    The spectrum has room for response and signal, so nothing wraps round into what is kept."""
    whole = np.concatenate([np.zeros(max(0, keep + len(response) - 1 - len(before))), before, x])[-(keep + len(response) - 1 + len(x)) :]
    block = 1 << (max(4 * len(response), 1 << 12) - 1).bit_length()
    step, spectrum = block - len(response) + 1, np.fft.rfft(response, block)
    out = []
    for at in range(0, keep + len(x), step):
        part = whole[at : at + block]
        out.append(np.fft.irfft(np.fft.rfft(part, block) * spectrum, block)[len(response) - 1 : len(part)])
    return np.concatenate(out)[: keep + len(x)] if out else np.zeros(0)


def response(rate: int) -> np.ndarray:
    """The high-pass filter as its answer to one sample."""
    n = int(RESPONSE_S * rate)
    return high_pass(np.eye(1, n)[0], rate)


def chunk_envelope(before: np.ndarray, x: np.ndarray, last: bool, rate: int, filter_: np.ndarray) -> np.ndarray:
    """Root of the moving mean power of the filtered samples of a chunk; the last chunk has the mean's end too."""
    mean = max(1, rate // MEAN)
    power = overlap_save(before, x, filter_, mean - 1) ** 2
    if last:
        power = np.concatenate([power, np.zeros(mean - 1)])
    sums = np.lib.stride_tricks.sliding_window_view(power, mean).sum(1) if len(power) >= mean else np.zeros(0)
    return np.sqrt(sums / mean)


def enveloped(chunks: DataFrame, by: list[str], samples: str, size: int, rate: int) -> DataFrame:
    """by, chunk, samples, before and n (samples of the recording) of all chunks."""
    halo = int(RESPONSE_S * rate) - 1 + max(1, rate // MEAN) - 1
    lengths = chunks.groupBy(*by).agg(F.max(F.col("chunk") * size + F.size(samples)).alias("n"))
    return with_halo(chunks, by, samples, size, halo).join(lengths, by)


def extremes(raw: DataFrame, key: str, samples: str, size: int, rate: int) -> DataFrame:
    """key, low and high: the least and the largest value of each recording's envelope without its first and last tenth of
    a second; recordings that have no more than these are out."""
    edge, mean = rate // EDGE, max(1, rate // MEAN)

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_ = response(rate)
        for part in parts:
            rows = []
            for k, chunk, x, before, n in part.itertuples(index=False):
                e = chunk_envelope(np.asarray(before, float), np.asarray(x, float), chunk * size + len(x) == n, rate, filter_)
                e = e[max(0, edge - chunk * size) : max(0, n + mean - 1 - edge - chunk * size)]
                if len(e):
                    rows.append((k, e.min(), e.max()))
            yield pd.DataFrame(rows, columns=[key, "low", "high"])

    kind = raw.schema[key].dataType.simpleString()
    found = enveloped(raw, [key], samples, size, rate).select(key, "chunk", "samples", "before", "n").mapInPandas(measure, f"{key} {kind}, low double, high double")
    return found.groupBy(key).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def loud(stems: DataFrame, key: str, source: str, samples: str, size: int, rate: int, scale: DataFrame) -> DataFrame:
    """key, source, run_begin, run_end and n (values of the envelope) of the stretches of each chunk in which the envelope,
    scaled by that of the raw recording, is above SHARE."""
    mean = max(1, rate // MEAN)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_ = response(rate)
        for part in parts:
            rows = []
            for k, s, chunk, x, before, n, low, high in part.itertuples(index=False):
                e = chunk_envelope(np.asarray(before, float), np.asarray(x, float), chunk * size + len(x) == n, rate, filter_)
                on = np.concatenate([[False], (e - low) / (high - low + 1e-6) > SHARE, [False]])
                edges = np.flatnonzero(on[1:] != on[:-1]) + chunk * size
                rows += [(k, s, b, t, n + mean - 1) for b, t in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=[key, source, "run_begin", "run_end", "n"])

    kinds = ", ".join(f"{c} {stems.schema[c].dataType.simpleString()}" for c in (key, source))
    ready = enveloped(stems, [key, source], samples, size, rate).join(scale, key)
    return ready.select(key, source, "chunk", "samples", "before", "n", "low", "high").mapInPandas(cut, f"{kinds}, run_begin long, run_end long, n long")


def clips(raw: DataFrame, stems: DataFrame, key: str, source: str, samples: str, size: int, rate: int) -> DataFrame:
    """key, source, begin and end (in samples) of the clips in the stems of each recording.

    raw has key, chunk (from 0) and samples; stems have a source too. Chunks have `size` samples, the last of a recording
    may have fewer. A clip is where the stem's envelope is above a quarter of the range of the raw recording's; silences of
    under a tenth of a second are closed, runs that touch an end of the recording or are too short go, and a twentieth of
    a second is put on both sides; an end may so lie behind that of the recording. Recordings of a fifth of a second or
    less have no clips.
    """
    found = loud(stems, key, source, samples, size, rate, extremes(raw, key, samples, size, rate))
    pad = int(PAD_S * rate)
    # Runs that a border cuts touch, and so are joined with all others that are near enough.
    kept = long_enough(filled(found.withColumn("_of", F.struct(key, source)), ["_of"], max(0, int(HOLE_S * rate) - 2)), int(LEAST_S * rate))
    return kept.select("_of.*", F.greatest(F.lit(0).cast("long"), F.col("run_begin") - pad).alias("begin"), (F.col("run_end") + pad).alias("end"))


def clip_samples(stems: DataFrame, found: DataFrame, key: str, source: str, samples: str, size: int, rate: int) -> DataFrame:
    """found (key, source, begin, end) with the samples of each clip and of a ramp on each side of it, over which they rise
    from silence and fall back. A clip's samples come from the chunks that it reaches, and are one row."""
    ramp = int(RAMP_S * rate)
    low, high = F.greatest(F.lit(0).cast("long"), F.col("begin") - ramp), F.col("end") + ramp
    reached = found.select(key, source, "begin", "end", F.explode(F.sequence(F.floor(low / size), F.floor((high - 1) / size))).alias("chunk"))
    first = F.greatest(F.lit(0).cast("long"), low - F.col("chunk") * size)
    n = F.least(F.size(samples).cast("long"), high - F.col("chunk") * size) - first
    pieces = reached.join(stems, [key, source, "chunk"]).where(n > 0).select(key, source, "begin", "end", "chunk", F.slice(samples, (first + 1).cast("int"), n.cast("int")).alias("x"))
    whole = pieces.groupBy(key, source, "begin", "end").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "x"))), lambda p: p["x"])).alias("x"))
    rise = lambda i: F.least(F.lit(1.0), i / float(max(1, ramp - 1)))
    return whole.withColumn("samples", F.transform("x", lambda v, i: v * rise(i) * rise(F.size("x") - 1 - i))).drop("x")
