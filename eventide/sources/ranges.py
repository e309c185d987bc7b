"""Long files by byte ranges, as data sources of Spark: PCM recordings in chunks of time, headers, and .npy matrices.

A file is cut into ranges of bytes by its size alone; each is a task's work, or several small files are. A task reads the
file's head and then only the blocks that begin in its range, one at a time: what it holds at once is a block, whatever
the file's size. Filters on the path, on the number of a block and on its begin reach the source, so that an excerpt of a
long recording is a few reads. Files lie where pyarrow can open them: local or mounted folders, hdfs, s3, gs.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from eventide.sources.audio import CHUNK_SECONDS

#: Bytes of a file that one task reads; bytes that are looked at for a header at once; bytes of a block of matrix rows.
RANGE_BYTES, HEAD_BYTES, BLOCK_BYTES = 64 << 20, 1 << 16, 4 << 20
#: Tasks, about, beyond which ranges are longer than asked for: all files are read, but not in ever more small tasks.
TASKS = 1000
#: Tags of WAV sample formats.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


@dataclass
class WavHead:
    rate: int
    channels: int
    width: int
    is_float: bool
    start: int
    frames: int


def wav_head(data: pa.NativeFile) -> WavHead:
    """Where the samples of a RIFF, RF64 or BW64 file stand and what they are. Of a file that is cut off those that are
    there count; chunks before the samples are passed over, however long. ValueError for anything else."""
    size, head = data.size(), data.read_at(min(HEAD_BYTES, data.size()), 0)
    if head[:4] not in (b"RIFF", b"RF64", b"BW64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found, long = 12, None, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", data.read_at(8, at))
        body = data.read_at(min(n, 40), at + 8) if name in (b"fmt ", b"ds64") else b""
        if name == b"ds64":
            long = struct.unpack("<QQ", body[:16])[1]
        elif name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            kind = struct.unpack("<H", body[24:26])[0] if kind == EXTENSIBLE and len(body) >= 26 else kind
            if kind not in (PCM, FLOAT) or not channels or not rate or bits not in ((8, 16, 24, 32) if kind == PCM else (32, 64)):
                raise ValueError(f"samples of kind {kind} with {bits} bits can't be read")
            found = (rate, channels, bits // 8, kind == FLOAT)
        elif name == b"data":
            if found is None:
                break
            n = long if n == 0xFFFFFFFF and long is not None else n
            return WavHead(*found, at + 8, min(n, size - at - 8) // (found[1] * found[2]))
        at += 8 + n + (n & 1)
    raise ValueError("no samples")


def wav_samples(raw: bytes, head: WavHead, channel: int | None) -> np.ndarray:
    """Samples of one channel (from 0), or the mean of all; whole numbers are scaled to [-1, 1)."""
    if head.is_float:
        x = np.frombuffer(raw, f"<f{head.width}").astype(float)
    elif head.width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif head.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{head.width}") / 2.0 ** (8 * head.width - 1)
    x = x.reshape(-1, head.channels)
    return x.mean(1) if channel is None else x[:, channel]


@dataclass
class NpyHead:
    dtype: np.dtype
    rows: int
    columns: int
    start: int


def npy_head(data: pa.NativeFile) -> NpyHead:
    """Of a vector or a matrix of numbers stored by rows; of more dimensions, all but the first make a row."""
    head = data.read_at(min(HEAD_BYTES, data.size()), 0)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    n, at = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
    said = ast.literal_eval(data.read_at(n, at).decode("latin1").strip())
    dtype, shape = np.dtype(said["descr"]), said["shape"]
    if said["fortran_order"] and len(shape) > 1 or dtype.kind not in "iufb":
        raise ValueError("only numbers stored by rows can be read")
    rows = shape[0] if shape else 1
    return NpyHead(dtype, rows, int(np.prod(shape[1:], dtype=np.int64)), at + n)


@dataclass
class Ranges(InputPartition):
    """(path, first byte, end) of what a task reads."""

    parts: list[tuple[str, int, int]]


@dataclass
class Bounds:
    """What filters leave of paths, of the numbers of blocks, and of the seconds at which they begin."""

    paths: set[str] | None = None
    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)

    def take(self, f: Filter) -> None:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "path" and isinstance(f, EqualTo | In):
            paths = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.paths = paths if self.paths is None else self.paths & paths
        elif name in ("chunk", "row", "begin_s"):
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.least[name] = max(self.least.get(name, f.value), f.value)
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.most[name] = min(self.most.get(name, f.value), f.value)

    def span(self, name: str, first: int, end: int, per_second: float | None = None) -> tuple[int, int]:
        """Of blocks first to end (exclusive), those that may be left; a block begins after number / per_second seconds."""
        low, high = self.least.get(name, first), self.most.get(name, end)
        if per_second:
            low = max(low, int(self.least.get("begin_s", 0) * per_second) - 1)
            high = min(high, int(self.most.get("begin_s", end / per_second) * per_second) + 1)
        return max(first, int(np.floor(low))), min(end, int(np.floor(high)) + 1)


class RangeReader(DataSourceReader):
    suffix = ""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.options, self.bounds = dict(options), Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters bound what is read; Spark checks them again, row by row."""
        for f in filters:
            self.bounds.take(f)
            yield f

    def listed(self) -> list[tuple[str, int]]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and (x.path.endswith(self.suffix) or x.path == path))

    def partitions(self) -> list[Ranges]:
        files = [(p, n) for p, n in self.listed() if self.bounds.paths is None or p in self.bounds.paths]
        whole = max(self.size, -(-sum(n for _, n in files) // TASKS))
        out, held, size = [], [], 0
        for path, n in files:
            for at in range(0, max(n, 1), whole):
                part = (path, at, min(at + whole, max(n, 1)))
                if held and size + part[2] - at > whole:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append(part)
                size += part[2] - at
        return [*out, Ranges(held)] if held else out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for path, first, end in partition.parts:
            with system.open_input_file(path) as data:
                try:
                    yield from self.blocks(path, data, first, end)
                except ValueError as e:
                    if self.options.get("unreadable", "fail") == "fail":
                        raise ValueError(f"{path}: {e}") from e

    def blocks(self, path: str, data: pa.NativeFile, first: int, end: int) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class WavReader(RangeReader):
    suffix = ".wav"

    def blocks(self, path, data, first, end):
        head = wav_head(data)
        channel = int(self.options["channel"]) if "channel" in self.options else None
        if channel is not None and channel >= head.channels:
            raise ValueError(f"there is no channel {channel}")
        size = max(1, int(head.rate * float(self.options.get("seconds", CHUNK_SECONDS))))
        wide = head.channels * head.width
        # Those chunks are this range's whose first byte is in it.
        low, high = (max(0, -(-(x - head.start) // (size * wide))) for x in (first, end))
        low, high = self.bounds.span("chunk", low, min(high, -(-head.frames // size)), head.rate / size)
        for chunk in range(low, high):
            n = min(size, head.frames - chunk * size)
            x = wav_samples(data.read_at(n * wide, head.start + chunk * size * wide), head, channel)
            columns = [[path], [chunk], [chunk * size / head.rate], [head.rate], [x]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["path", "chunk", "begin_s", "sample_rate", "samples"])


class HeadReader(RangeReader):
    suffix = ".wav"

    def partitions(self) -> list[Ranges]:
        found = [(p, 0, n) for p, n in self.listed() if self.bounds.paths is None or p in self.bounds.paths]
        return [Ranges(found[i : i + 1000]) for i in range(0, len(found), 1000)] or [Ranges([])]

    def blocks(self, path, data, first, end):
        try:
            head, error = wav_head(data), None
        except ValueError as e:
            head, error = None, str(e)
        row = [path, *((head.rate, head.channels, head.frames, head.frames / head.rate) if head else (None,) * 4), error]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["path", "sample_rate", "channels", "frames", "duration_sec", "error"])


class NpyReader(RangeReader):
    suffix = ".npy"

    def blocks(self, path, data, first, end):
        head = npy_head(data)
        wide = head.columns * head.dtype.itemsize
        low, high = (max(0, -(-(x - head.start) // wide)) if wide else 0 for x in (first, end))
        low, high = self.bounds.span("row", low, min(high, head.rows))
        step = max(1, BLOCK_BYTES // max(1, wide))
        for at in range(low, high, step):
            n = min(step, high - at)
            x = np.frombuffer(data.read_at(n * wide, head.start + at * wide), head.dtype).astype(float)
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * head.columns), pa.array(x))
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at, at + n)), values], names=["path", "row", "values"])


class RangeSource(DataSource):
    columns, kind = "", RangeReader

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return self.kind(dict(self.options))


class WavSource(RangeSource):
    columns, kind = "path string, chunk long, begin_s double, sample_rate int, samples array<double>", WavReader

    @classmethod
    def name(cls) -> str:
        return "eventide_wav"


class HeadSource(RangeSource):
    columns, kind = "path string, sample_rate int, channels int, frames long, duration_sec double, error string", HeadReader

    @classmethod
    def name(cls) -> str:
        return "eventide_wav_head"


class NpySource(RangeSource):
    columns, kind = "path string, row long, values array<double>", NpyReader

    @classmethod
    def name(cls) -> str:
        return "eventide_npy"


def source(spark: SparkSession, kind: type[RangeSource], path: str, **options) -> DataFrame:
    """A table of files below a path. Lets the session hand filters to sources in Python, which is off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(kind)
    reader = spark.read.format(kind.name())
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load(path)


def wav(spark: SparkSession, path: str, seconds: float = CHUNK_SECONDS, channel: int | None = None, unreadable: str = "fail", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, chunk, begin_s, sample_rate and samples of the WAV files below a folder (or of one file), in chunks of
    `seconds`: the mean of the channels, or one of them. Files that can't be read fail the job, or with unreadable="skip"
    are left out. Filters on path, chunk and begin_s bound what is read. Empty recordings have no chunks."""
    return source(spark, WavSource, path, seconds=seconds, channel=channel, unreadable=unreadable, rangebytes=range_bytes)


def wav_heads(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate, channels, frames, duration_sec and error of WAV files, from their heads alone."""
    return source(spark, HeadSource, path)


def npy(spark: SparkSession, path: str, unreadable: str = "fail", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, row and values of the rows of .npy matrices. Filters on path and row bound what is read."""
    return source(spark, NpySource, path, unreadable=unreadable, rangebytes=range_bytes)


def centred(chunks: DataFrame, by: str = "path", samples: str = "samples") -> DataFrame:
    """chunks without the mean of their recording, which is that of all its chunks."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    means = chunks.groupBy(by).agg((F.sum(add(F.col(samples))) / F.sum(F.size(samples))).alias("_mean"))
    return chunks.join(means, by).withColumn(samples, F.transform(samples, lambda x: x - F.col("_mean"))).drop("_mean")


def excerpts(chunks: DataFrame, begin_s: float, end_s: float, seconds: float, by: str = "path") -> DataFrame:
    """by and samples from begin_s to end_s of chunks of `seconds`; of files, only chunks that hold some are read."""
    rate, at = F.col("sample_rate"), F.col("chunk") * F.floor(F.col("sample_rate") * seconds)
    low, high = F.greatest(F.lit(0), F.floor(begin_s * rate) - at), F.least(F.size("samples"), F.floor(end_s * rate) - at)
    wanted = chunks.where((F.col("begin_s") >= begin_s - seconds) & (F.col("begin_s") <= end_s)).where(high > low)
    part = wanted.select(by, "chunk", F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("x"))
    return part.groupBy(by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "x"))), lambda s: s["x"])).alias("samples"))


def write_wav(chunks: DataFrame, by: str, samples: str, folder: str, rate: int) -> DataFrame:
    """Write each recording of chunks (by, chunk, samples) as a WAV file <by>.wav of 16 bits, an RF64 file beyond 4 GB, and
    return by and bytes. A file is one stream, and so one task's; the task holds a batch of chunks at a time. Files go to a new name
    and are renamed when they are complete, so a task that is run again does no harm."""
    sizes = chunks.groupBy(by).agg((2 * F.sum(F.size(samples))).alias("_bytes"))
    kind = chunks.schema[by].dataType.simpleString()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        out, size = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                name, size = batch.column(0)[0].as_py(), batch.column(2)[0].as_py()
                temporary, first = f"{path}/.{name}.{np.random.default_rng().integers(1 << 62)}", batch.slice(0, 1)
                out, left = system.open_output_stream(temporary, compression=None), size
                form = struct.pack("<4sIHHIIHH", b"fmt ", 16, PCM, 1, rate, 2 * rate, 2, 16)
                if size + 36 < 1 << 32:
                    out.write(struct.pack("<4sI4s", b"RIFF", size + 36, b"WAVE") + form + struct.pack("<4sI", b"data", size))
                else:
                    out.write(struct.pack("<4sI4s4sIQQQI", b"RF64", 0xFFFFFFFF, b"WAVE", b"ds64", 28, size + 72, size, size // 2, 0) + form + struct.pack("<4sI", b"data", 0xFFFFFFFF))
            for chunk in batch.column(1):
                x = chunk.values.to_numpy(zero_copy_only=False)
                out.write((np.clip(x, -1, 1 - 2**-15) * 2**15).round().astype("<i2").tobytes())
                left -= 2 * len(x)
        if out is not None:
            out.close()
            if left:
                raise ValueError(f"{name}: {size - left} bytes of samples instead of {size}")
            system.move(temporary, f"{path}/{name}.wav")
            yield pa.RecordBatch.from_arrays([first.column(0), first.column(2)], names=[by, "bytes"])

    # Grouped, and not only repartitioned: the plan may pass over a repartition, but not over what a group needs.
    ready = chunks.join(sizes, by).repartition(by).sortWithinPartitions(by, "chunk").select(by, F.col(samples).cast("array<double>"), "_bytes")
    return ready.groupBy(by).applyInArrow(save, f"{by} {kind}, bytes long")
