import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.sources import audio, readers, writers


def test_predictions_header(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("Audiofilename,Starttime,Endtime\na.wav,1.5,2\n")
    bad.write_text("Audiofilename,Endtime,Starttime\na.wav,1.5,2\n")
    assert [tuple(r) for r in readers.predictions(spark, str(good)).collect()] == [("a.wav", 1.5, 2.0)]
    with pytest.raises(readers.HeaderError):
        readers.predictions(spark, str(bad))


def test_delimiters(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1;x\n2;y\n")
    rows = readers.delimited(spark, str(tmp_path / "a.txt"), "n int, s string", sep=";", header=False).collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, "y")]
    (tmp_path / "b.txt").write_text("oops;x\n")
    with pytest.raises(Exception):
        readers.delimited(spark, str(tmp_path / "b.txt"), "n int, s string", sep=";", header=False).collect()


def test_selection_tables_round_trip(spark, tmp_path):
    events = spark.createDataFrame([("f1", 0.5, 1.0, "POS"), ("f2", 2.0, 3.0, "UNK")], "file_id string, begin_s double, end_s double, annotation string")
    writers.selection_tables(events, str(tmp_path / "out"))
    read = readers.selection_table(spark, str(tmp_path / "out" / "file_id=f1"), default_channel=1)
    assert read.select("begin_s", "end_s", "annotation", "channel").collect() == [(0.5, 1.0, "POS", 1)]


def test_small_files_are_many_tasks_work(spark, tmp_path):
    """Files that hold few bytes each are still dealt out, whatever their names; what is there is not written over."""
    names = [f"a/b c={i}%" for i in range(30)] + [None]
    rows = spark.createDataFrame([(v, 0.5 * i, i / 3, x) for i, v in enumerate(names) for x in ("a\tb", 'say "x"', None)], "file_id string, begin_s double, end_s double, annotation string").coalesce(1)
    writers.selection_tables(rows, str(tmp_path / "t"))
    read = readers.selection_table(spark, str(tmp_path / "t"), default_channel=1).select("file_id", "begin_s", "end_s", "annotation")
    assert sorted(map(repr, map(tuple, read.collect()))) == sorted(map(repr, map(tuple, rows.collect())))
    assert len({f.name.split("-")[1] for f in (tmp_path / "t").glob("*/part-*")}) > 1
    texts = spark.createDataFrame([(f"f{i}", json.dumps({f"f{i}": [{"start": i, "end": i + 1, "label": "x"}]})) for i in range(30)], "file string, json string").coalesce(1)
    writers.documents(texts, "file", "json", str(tmp_path / "d"))
    assert sorted(r["begin_s"] * 1000 for r in readers.interval_json_file(spark, str(tmp_path / "d")).collect()) == list(range(30))
    assert len({f.name.split("-")[1] for f in (tmp_path / "d").glob("*/part-*")}) > 1
    with pytest.raises(FileExistsError):
        writers.documents(texts, "file", "json", str(tmp_path / "d"))
    writers.documents(texts.limit(2), "file", "json", str(tmp_path / "d"), mode="overwrite")
    assert readers.interval_json_file(spark, str(tmp_path / "d")).count() == 2


def test_lists_and_listing(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "list.txt").write_text(" a \n\n b\n")
    assert sorted(r[0] for r in readers.text_list(spark, str(tmp_path / "l")).collect()) == ["a", "b"]
    found = readers.listing(spark, str(tmp_path), "*.txt").collect()
    assert [(r["folder"], r["name"]) for r in found] == [("l", "list.txt")]


def test_nested_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"f": [{"start": 500, "end": 1000, "label": "x"}]}, indent=1))
    assert [tuple(r) for r in readers.interval_json_file(spark, str(tmp_path / "a.json")).collect()] == [("f", 0.5, 1.0, "x")]
    (tmp_path / "m.json").write_text(json.dumps({"d": {"s": {"c": ["f1", "f2"]}}}))
    assert sorted(tuple(r) for r in readers.set_metadata(spark, str(tmp_path / "m.json")).collect()) == [("d", "s", "c", "f1"), ("d", "s", "c", "f2")]


def test_report_round_trip(spark, tmp_path):
    overall = spark.createDataFrame([(0.5, 0.25)], "precision double, recall double")
    by_set = spark.createDataFrame([("S1", 0.5)], "set_id string, precision double")
    by_file = spark.createDataFrame([("f1", 0.5), ("f2", 1.0)], "file_id string, precision double")
    text = writers.report_json(overall, by_set, by_file, "team", "EVAL")
    text.write.text(str(tmp_path / "r"))
    read = readers.report_scores(spark, str(tmp_path / "r")).collect()
    assert {r["file_id"]: r["scores"]["precision"] for r in read} == {"f1": 0.5, "f2": 1.0}


def test_lists_and_commands_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5)], "f string, d double")
    writers.text_list(rows, "f", str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a"]
    assert [r[0] for r in writers.commands(rows, "run --file %s --len %.1f", ["f", "d"]).collect()] == ["run --file a --len 1.5"]
    writers.table(rows, str(tmp_path / "c"))
    assert readers.as_text(spark, str(tmp_path / "c")).collect() == [("a", "1.5")]


def test_wav(spark, tmp_path):
    x = (np.sin(np.arange(2500) / 10) * 0.5).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(audio.encode(x, 1000))
    (tmp_path / "broken.wav").write_bytes(b"no")
    found = {r["path"].rsplit("/", 1)[1]: r for r in audio.durations(spark, str(tmp_path)).collect()}
    assert found["a.wav"]["duration_sec"] == 2.5 and found["broken.wav"]["error"]
    (tmp_path / "broken.wav").unlink()
    cut = audio.chunks(spark, str(tmp_path), seconds=1)
    assert sorted((r["chunk"], len(r["samples"])) for r in cut.collect()) == [(0, 1000), (1, 1000), (2, 500)]
    part = audio.excerpt(cut, 0.9, 1.2, seconds=1).collect()[0]["samples"]
    assert np.allclose(part, (x - x.mean())[900:1200], atol=1e-3)
    assert len(audio.decode(audio.encode(x, 1000), 500)[1]) == 1250
    out = writers.clips(audio.excerpt(cut, 0, 1, seconds=1), 1000).collect()[0]["content"]
    assert len(audio.decode(bytes(out))[1]) == 1000


def test_unpivot(spark):
    wide = spark.createDataFrame([("f", 0.0, 1.0, "POS", "NEG")], "f string, b double, e double, c1 string, c2 string")
    long = readers.unpivot_classes(wide, ["f", "b", "e"], [])
    assert sorted((r["class"], r["q"]) for r in long.collect()) == [("c1", "POS"), ("c2", "NEG")]
    assert long.where(F.col("q") == "POS").count() == 1


def test_resumable_writes(spark, tmp_path):
    """Shares that an earlier run has finished are not made again; one that it left half done is."""
    rows, path = spark.range(100), str(tmp_path / "r")
    assert writers.resumable(rows, "id", path, 4, lambda x: x) == 4
    (tmp_path / "r" / "share=2" / "_SUCCESS").unlink()
    assert writers.resumable(rows, "id", path, 4, lambda x: x) == 1
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(100))


def test_headers_and_channels(spark):
    x = np.stack([np.linspace(-0.5, 0.5, 100), np.zeros(100)], 1)
    whole = audio.encode(x, 50)
    rows = spark.createDataFrame([("a", whole), ("b", whole[:-200]), ("c", b"RIFF"), ("d", b"")], "path string, content binary")
    got = {r["path"]: (r["sample_rate"], r["duration_sec"], r["error"] is None) for r in audio.probed(rows).collect()}
    assert got == {"a": (50, 2.0, True), "b": (50, 1.0, True), "c": (None, None, False), "d": (None, None, False)}
    assert audio.decode(whole, channel=0)[1][0] == pytest.approx(-0.5, abs=1e-4) and not audio.decode(whole, channel=1)[1].any()
    assert audio.decode(audio.encode(x[:, 0], 50, told_rate=25))[0] == 25
