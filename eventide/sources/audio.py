"""PCM WAV files: headers, decoding to bounded chunks, and writing."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SECONDS = 30
#: Bytes of a file that hold its header.
HEADER_BYTES = 4096
CHUNK_SCHEMA = "path string, chunk int, sample_rate int, samples array<float>"


def _pcm(frames: bytes, width: int, channels: int) -> np.ndarray:
    """Samples in [-1, 1) as (frames, channels)."""
    if width == 1:
        data = (np.frombuffer(frames, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        raw = np.frombuffer(frames, np.uint8).reshape(-1, 3).astype(np.int32)
        data = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8).astype(float) / 2**23
    else:
        data = np.frombuffer(frames, {2: "<i2", 4: "<i4"}[width]).astype(float) / 2 ** (8 * width - 1)
    return data.reshape(-1, channels)


def resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation at another rate."""
    if rate == target or not len(x):
        return x
    n = int(len(x) * target / rate)
    return np.interp(np.arange(n) * rate / target, np.arange(len(x)), x)


def decode(content: bytes, target_rate: int | None = None, channel: int | None = None) -> tuple[int, np.ndarray]:
    """Rate and samples of a file: the mean of each channel is removed, then channels are averaged, or one is taken."""
    with wave.open(io.BytesIO(content)) as f:
        rate = f.getframerate()
        data = _pcm(f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels())
    data = data - data.mean(0) if len(data) else data
    mono = data[:, channel] if channel is not None else data.mean(1) if len(data) else data[:, 0]
    return target_rate or rate, resampled(mono, rate, target_rate or rate)


def encode(samples: np.ndarray, rate: int, told_rate: int | None = None) -> bytes:
    """A file of 16 bits, of one channel or of one for each column of samples. told_rate is what the header says: a
    reader then plays the samples slower or faster, as recordings of ultrasound are stored."""
    samples = np.asarray(samples, float)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1 if samples.ndim == 1 else samples.shape[1])
        f.setsampwidth(2)
        f.setframerate(told_rate or rate)
        f.writeframes((np.clip(samples, -1, 1 - 2**-15) * 2**15).round().astype("<i2").tobytes())
    return out.getvalue()


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the WAV files below a folder; files are 2 GB at most."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", "content")


def probed(found: DataFrame) -> DataFrame:
    """path, sample_rate, duration_sec and error of files (path, content); one that can't be read has an error and no
    duration. Only the first HEADER_BYTES of a file and its size go to Python: a header tells how many bytes follow, and
    of a file that is cut off those that are there count."""

    @F.pandas_udf("struct<sample_rate int, duration_sec double, error string>")
    def probe(heads: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = []
        for head, size in zip(heads, sizes, strict=True):
            try:
                stream = io.BytesIO(head)
                with wave.open(stream) as f:
                    there = max(0, size - (head.find(b"data") + 8)) // (f.getsampwidth() * f.getnchannels())
                    rows.append((f.getframerate(), min(f.getnframes(), there) / f.getframerate(), None))
            except (wave.Error, EOFError) as e:
                rows.append((None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["sample_rate", "duration_sec", "error"])

    head = F.substring("content", 1, HEADER_BYTES)
    return found.select("path", probe(head, F.octet_length("content").cast("long")).alias("p")).select("path", "p.*")


def durations(spark: SparkSession, path: str) -> DataFrame:
    """probed() of the WAV files below a folder."""
    return probed(files(spark, path))


def cut(found: DataFrame, target_rate: int | None = None, channel: int | None = None, seconds: float = CHUNK_SECONDS) -> DataFrame:
    """path, chunk, sample_rate and samples of files (path, content) in chunks, so that no row holds a whole recording."""

    def decoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path_, content in zip(part["path"], part["content"], strict=True):
                rate, x = decode(content, target_rate, channel)
                size = int(rate * seconds)
                rows = [(path_, i, rate, x[i * size : (i + 1) * size].astype(np.float32)) for i in range(-(-len(x) // size))]
                yield pd.DataFrame(rows, columns=["path", "chunk", "sample_rate", "samples"])

    return found.select("path", "content").mapInPandas(decoded, CHUNK_SCHEMA)


def chunks(spark: SparkSession, path: str, target_rate: int | None = None, channel: int | None = None, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """cut() of the WAV files below a folder. Written as Parquet sorted by path and chunk, later reads take only the
    chunks that they ask for."""
    return cut(files(spark, path), target_rate, channel, seconds)


def excerpt(chunked: DataFrame, begin_s: float, end_s: float, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """path and samples from begin_s to end_s; of a stored table of chunks, only those that hold
    them are read."""
    wanted = chunked.where(F.col("chunk").between(int(begin_s // seconds), int(end_s // seconds)))
    at = F.col("chunk") * seconds * F.col("sample_rate")
    low = F.greatest(F.lit(0), (F.lit(begin_s) * F.col("sample_rate")).cast("long") - at)
    high = F.least(F.size("samples"), (F.lit(end_s) * F.col("sample_rate")).cast("long") - at)
    part = wanted.where(high > low).select("path", "chunk", F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("x"))
    return part.groupBy("path").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "x"))), lambda s: s["x"])).alias("samples"))
