"""Two-level scans: one long group cut into slices gives what one scan of it gives."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import intervals, runs, scans


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(scans, "LONG", 20)
    monkeypatch.setattr(scans, "SLICES", 9)


def plain_islands(rows):
    out = []
    for b, e in sorted(r for r in rows if r[1] > r[0]):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def test_islands_of_a_long_recording(spark, short):
    random.seed(3)
    by = {None: [], "a": [], "b": [], "burst": []}
    for _ in range(700):
        b = random.randrange(20_000)
        by["a"].append((b, b + random.choice([0, 1, 5, 9, 600])))
        by[None].append((b // 3, b // 3 + 2))
    by["a"].append((100, 15_000))
    by["b"] = [(5, 6), (6, 8), (9, 9)]
    by["burst"] = [(7, 8)] * 300 + [(8, 9), (30, 31)]  # a tie of most rows
    df = spark.createDataFrame([(k, b, e) for k, rows in by.items() for b, e in rows], "f string, b long, e long").repartition(4)
    sizes = scans.sliced(df, ["f"], "b").groupBy("f", "_slice").count().collect()
    assert len([r for r in sizes if r["f"] == "a"]) > 5 and len([r for r in sizes if r["f"] == "b"]) == 1
    got = intervals.merged(df, ["f"], "b", "e", n=F.count("*")).collect()
    for k, rows in by.items():
        assert sorted((r["b"], r["e"]) for r in got if r["f"] == k) == plain_islands(rows)
    assert sum(r["n"] for r in got) == sum(e > b for rows in by.values() for b, e in rows)


def plain_runs(mask):
    edges = [i for i in range(len(mask) + 1) if (i < len(mask) and mask[i]) != (i > 0 and mask[i - 1])]
    return list(zip(edges[::2], edges[1::2], strict=True))


def test_runs_of_a_long_recording(spark, short):
    random.seed(4)
    masks = {"a": [random.random() < 0.6 for _ in range(2000)], "b": [True] * 500, "c": [False] * 30, "d": [False, True]}
    df = spark.createDataFrame([(k, i, x) for k, m in masks.items() for i, x in enumerate(m)], "f string, frame long, x boolean").repartition(3)
    found = runs.runs(df, "f", "frame", F.col("x"))
    got = found.collect()
    filled = runs.filled(found, ["f"], 2).collect()
    for k, mask in masks.items():
        own = plain_runs(mask)
        assert sorted((r["run_begin"], r["run_end"]) for r in got if r["f"] == k) == own
        want = []
        for b, e in own:
            if want and b - want[-1][1] <= 2:
                want[-1][1] = e
            else:
                want.append([b, e])
        assert sorted([r["run_begin"], r["run_end"]] for r in filled if r["f"] == k) == want
        assert all(r["n"] == len(mask) for r in filled if r["f"] == k)


def test_thresholds_do_not_depend_on_slices(spark, short, monkeypatch):
    random.seed(5)
    rows = [(f, i, random.random() ** 2) for f in "ab" for i in range(3000)]
    frames = spark.createDataFrame(rows, "f string, frame long, p double").repartition(4)
    support = spark.createDataFrame([("a", 0.2, 0.1, 0.08), ("b", 0.1, 0.05, 0.1)], "f string, mean_s double, std_s double, min_s double")
    cut = sorted(runs.adaptive_threshold(frames, support, "f").collect())
    monkeypatch.setattr(scans, "LONG", 10_000_000)
    whole = sorted(runs.adaptive_threshold(frames, support, "f").collect())
    assert [(r["f"], r["logit"], round(r["score"], 9)) for r in cut] == [(r["f"], r["logit"], round(r["score"], 9)) for r in whole]


def test_one_recording_of_all_events(spark, sf_dir, short):
    """All events as one recording: the scan is spread over slices, and no slice has the most of it."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(1).alias("f"), F.unix_micros(F.col("ts").cast("timestamp")).alias("b")).withColumn("e", F.col("b") + 7_000_000)
    sizes = [r["count"] for r in scans.sliced(df, ["f"], "b").groupBy("_slice").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 2 * min(sizes)
    rows = [(r["b"], r["e"]) for r in df.collect()]
    assert sorted((r["b"], r["e"]) for r in intervals.merged(df, ["f"], "b", "e").collect()) == plain_islands(rows)


def test_adaptive_thresholds_shuffle_frames_only(spark, monkeypatch):
    """No row for a frame and a grid point: those were tens of times the frames."""
    plans = []
    monkeypatch.setattr(runs, "materialize", lambda df: plans.append(df) or df, raising=False)
    frames = spark.range(200).selectExpr("id % 2 as f", "id div 2 as frame", "(id * 37 % 100) / 100.0 as p")
    support = spark.createDataFrame([(0, 0.2, 0.1, 0.1), (1, 0.3, 0.1, 0.2)], "f long, mean_s double, std_s double, min_s double")
    plans.append(runs.adaptive_threshold(frames, support, "f"))
    assert all("Generate" not in p._jdf.queryExecution().toString() for p in plans)
