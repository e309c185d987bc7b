"""Files by byte ranges: every sample once, whatever the ranges; long files by few reads."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.sources import ranges, writers


def wav_bytes(x, rate, width=2, kind=1, extra=b"", extensible=False):
    x = np.atleast_2d(np.asarray(x).T).T
    if kind == 3:
        body = x.astype(f"<f{width}").tobytes()
    elif width == 1:
        body = (x * 128 + 128).astype(np.uint8).tobytes()
    elif width == 3:
        body = b"".join(int(v).to_bytes(3, "little", signed=True) for v in (x * 2**23).astype(np.int64).ravel())
    else:
        body = (x * 2.0 ** (8 * width - 1)).astype(f"<i{width}").tobytes()
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, x.shape[1], rate, rate * width * x.shape[1], width * x.shape[1], 8 * width)
    if extensible:
        form += struct.pack("<HHIH", 22, 8 * width, 0, kind) + b"\0\0\0\0\x10\0\x80\0\0\xaa\0\x38\x9b\x71"
    chunks = struct.pack("<4sI", b"fmt ", len(form)) + form + extra + struct.pack("<4sI", b"data", len(body)) + body
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunks), b"WAVE") + chunks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(0)
    at, made = tmp_path_factory.mktemp("wav"), {}
    list_ = b"LIST" + struct.pack("<I", 100_001) + bytes(100_002)
    for name, width, kind, n, channels, how in (("a", 2, 1, 5000, 1, {}), ("b", 1, 1, 777, 2, {}), ("c", 3, 1, 1000, 3, {"extra": list_}), ("d", 4, 1, 1, 1, {}), ("e", 4, 3, 2500, 2, {"extensible": True}), ("f", 8, 3, 64, 1, {}), ("none", 2, 1, 0, 1, {})):
        x = rng.integers(-100, 100, (n, channels)) / 128
        made[name] = x
        (at / f"{name}.wav").write_bytes(wav_bytes(x, 100, width, kind, **how))
    cut = wav_bytes(made["a"], 100)
    (at / "sub").mkdir()
    (at / "sub" / "cut.wav").write_bytes(cut[:-1001])
    made["cut"] = made["a"][:4499]
    (at / "notes.txt").write_text("no")
    return at, made


@pytest.mark.parametrize("size", [100, 1000, 1 << 20])
def test_every_sample_once(spark, folder, size):
    at, made = folder
    df = ranges.wav(spark, str(at), seconds=0.7, range_bytes=size)
    got = {}
    for r in df.orderBy("path", "chunk").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1][:-4], []).append((r["chunk"], r["begin_s"], r["samples"]))
    assert set(got) == set(made) - {"none"}
    for k, parts in got.items():
        assert [c for c, _, _ in parts] == list(range(len(parts))) and all(len(x) == 70 for _, _, x in parts[:-1])
        assert np.allclose(np.concatenate([x for _, _, x in parts]), made[k].mean(1))
        assert [b for _, b, _ in parts] == [c * 70 / 100 for c, _, _ in parts]
    if size == 100:
        assert df.rdd.getNumPartitions() > 100
    one = ranges.wav(spark, f"{at}/e.wav", channel=1).collect()
    assert np.allclose(one[0]["samples"], made["e"][:, 1])


def test_heads(spark, folder):
    at, made = folder
    (at / "bad.wav").write_bytes(b"RIFFoops")
    (at / "empty.wav").write_bytes(b"")
    try:
        got = {r["path"].rsplit("/", 1)[1][:-4]: r for r in ranges.wav_heads(spark, str(at)).collect()}
        assert {k: (r["frames"], r["channels"]) for k, r in got.items() if not r["error"]} == {k: x.shape for k, x in made.items()}
        assert got["bad"]["error"] and got["empty"]["error"] and got["a"]["duration_sec"] == 50.0
        with pytest.raises(Exception, match="bad.wav"):
            ranges.wav(spark, str(at)).collect()
        assert ranges.wav(spark, str(at), unreadable="skip").select("path").distinct().count() == len(made) - 1
    finally:
        (at / "bad.wav").unlink()
        (at / "empty.wav").unlink()


def test_a_long_file_takes_few_reads(spark, tmp_path):
    """Five gigabytes of which two seconds are asked for; the file is sparse, and no task could hold it."""
    frames, rate = 5 << 29, 48_000
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(struct.pack("<4sI4s4sIQQQI", b"RF64", 0xFFFFFFFF, b"WAVE", b"ds64", 28, 2 * frames + 72, 2 * frames, frames, 0) + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16) + struct.pack("<4sI", b"data", 0xFFFFFFFF))
        start = f.tell()
        f.seek(start + 2 * 20_000 * rate)
        f.write(np.arange(1, 3 * rate + 1, dtype="<i2").tobytes())
        f.truncate(start + 2 * frames)
    head = ranges.wav_heads(spark, str(tmp_path)).first()
    assert head["frames"] == frames
    df = ranges.wav(spark, str(tmp_path), seconds=1)
    assert df.rdd.getNumPartitions() == -(-(2 * frames + start) // ranges.RANGE_BYTES) > 70
    got = ranges.excerpts(df, 20_000.5, 20_002.5, 1).first()["samples"]
    assert len(got) == 2 * rate and np.allclose(np.array(got[:4]) * 2**15, np.arange(24_001, 24_005).astype("<i2"))
    assert df.where("chunk between 20000 and 20001").agg(F.count("*"), F.sum(F.size("samples"))).first() == (2, 2 * rate)


def test_filters_bound_what_is_read(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    at, _ = folder
    reader = ranges.WavReader({"path": str(at), "seconds": "0.7", "rangebytes": "1000"})
    every = len(reader.partitions())
    assert list(reader.pushFilters([f := In(("path",), (f"{at}/a.wav", f"{at}/d.wav"))])) == [f]
    few = reader.partitions()
    assert 0 < len(few) < every and {p for x in few for p, _, _ in x.parts} == {f"{at}/a.wav", f"{at}/d.wav"}
    list(reader.pushFilters([GreaterThanOrEqual(("begin_s",), 7.0), LessThan(("begin_s",), 9.0), EqualTo(("path",), f"{at}/a.wav")]))
    chunks = [b.column(1)[0].as_py() for p in reader.partitions() for b in reader.read(p)]
    assert set(range(10, 13)) <= set(chunks) <= set(range(8, 15))


def test_centred_and_written_again(spark, folder, tmp_path):
    at, made = folder
    chunks = ranges.wav(spark, f"{at}/a.wav", seconds=3).select(F.lit("again").alias("name"), "chunk", "samples").repartition(3)
    assert ranges.write_wav(chunks, "name", "samples", str(tmp_path), 100).collect() == [("again", 10_000)]
    with wave.open(str(tmp_path / "again.wav")) as f:
        assert f.getnframes() == 5000 and f.getframerate() == 100
        assert np.allclose(np.frombuffer(f.readframes(5000), "<i2") / 2**15, made["a"][:, 0])
    centred = np.concatenate([r["samples"] for r in ranges.centred(ranges.wav(spark, str(tmp_path), seconds=3)).orderBy("chunk").collect()])
    assert np.allclose(centred, made["a"][:, 0] - made["a"].mean())


def test_matrices(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = {"m": rng.normal(size=(500, 7)), "i": rng.integers(0, 9, (40, 3)), "v": rng.normal(size=9).astype("f4"), "cube": rng.normal(size=(6, 2, 3)), "no": np.zeros((0, 4)), "big": rng.normal(size=(30, 5)).astype(">f8")}
    for k, x in made.items():
        np.save(tmp_path / f"{k}.npy", x)
    for size in (200, 1 << 20):
        got = {}
        for r in ranges.npy(spark, str(tmp_path), range_bytes=size).orderBy("path", "row").collect():
            got.setdefault(r["path"].rsplit("/", 1)[1][:-4], []).append((r["row"], r["values"]))
        assert set(got) == set(made) - {"no"}
        for k, rows in got.items():
            assert [i for i, _ in rows] == list(range(len(made[k]))) and np.allclose([v for _, v in rows], made[k].reshape(len(made[k]), -1))
    assert ranges.npy(spark, str(tmp_path)).where("row >= 490").count() == 10
    np.save(tmp_path / "f.npy", np.asfortranarray(made["m"]))
    with pytest.raises(Exception, match="by rows"):
        ranges.npy(spark, f"{tmp_path}/f.npy").collect()


def test_matrices_written(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i, [float(i), i / 2]) for i in range(50)], "f long, n long, v array<float>").repartition(4)
    assert sorted(writers.matrices(rows, "f", "n", "v", str(tmp_path)).collect()) == [(0, 17), (1, 17), (2, 16)]
    x = np.load(io.BytesIO((tmp_path / "1.npy").read_bytes()))
    assert x.dtype == np.float32 and x[:, 0].tolist() == list(range(1, 50, 3))


@pytest.fixture
def joins_turned(spark):
    """Joins are planned by sorting and turn into broadcasts when sizes are known, as they do on larger tables."""
    how = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in how.items():
        spark.conf.set(k, v)
    yield
    for k in how:
        spark.conf.unset(k)


def test_files_are_whole_whatever_the_join(spark, tmp_path, joins_turned):
    rows = spark.range(0, 4000, 1, 8).select(F.col("id"), (F.col("id") % 4).alias("file"), F.floor(F.col("id") / 4).alias("chunk"))
    vector = F.array(F.col("id").cast("float"), F.lit(1.0).cast("float"))
    written = writers.matrices(rows.withColumn("x", vector), "file", "id", "x", str(tmp_path / "npy")).collect()
    assert sorted(map(tuple, written)) == [(i, 1000) for i in range(4)]
    read = ranges.npy(spark, str(tmp_path / "npy")).collect()
    assert sorted(r["values"][0] for r in read) == list(range(4000))
    ranges.write_wav(rows.withColumn("x", F.array(F.col("id") / 8192)), "file", "x", str(tmp_path / "wav"), 10).collect()
    wavs = ranges.wav(spark, str(tmp_path / "wav"), seconds=10).orderBy("path", "chunk").collect()
    assert [x * 8192 for r in wavs for x in r["samples"]] == [i + 4 * k for i in range(4) for k in range(1000)]


def test_many_ranges_are_few_tasks(tmp_path):
    np.save(tmp_path / "a.npy", np.arange(60000.0))
    reader = ranges.NpyReader({"path": str(tmp_path), "rangebytes": "64"})
    parts = [p for task in reader.partitions() for p in task.parts]
    assert len(reader.partitions()) <= ranges.TASKS + 1
    assert [a for _, a, _ in parts[1:]] == [e for _, _, e in parts[:-1]] and parts[-1][2] == (tmp_path / "a.npy").stat().st_size
