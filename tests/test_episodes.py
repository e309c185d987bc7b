import numpy as np
from pyspark.sql import functions as F

from eventide.operators import episodes


def test_plans_are_whole_and_repeat(spark):
    clips = spark.range(300).select(F.col("id").alias("clip"), (F.col("id") % 9).alias("cluster"))
    a = episodes.plan(spark, 40, clips, "cluster", "clip", 5, 3, seed=4)
    rows = a.collect()
    assert len(rows) == 40 * 8
    assert sorted(map(tuple, rows)) == sorted(map(tuple, episodes.plan(spark, 40, clips.repartition(7), "cluster", "clip", 5, 3, seed=4).collect()))
    for e in range(40):
        own = [r for r in rows if r["episode"] == e]
        assert len({r["clip"] % 9 for r in own}) == 1 and sum(r["role"] == "support" for r in own) == 5
    assert episodes.plan(spark, 4, clips.limit(0), "cluster", "clip", 5, 3).count() == 0


def test_hard_supports(spark):
    rows = [("f", 0, 1, 0.1), ("f", 1, 0, 0.9), ("f", 2, 0, 0.2), ("f", 3, 0, 0.95)]
    found = episodes.hard_supports(spark.createDataFrame(rows, "f string, chunk int, n_events int, p double"), "f", 3)
    assert sorted(r["chunk"] for r in found.collect()) == [0, 1, 3]


def test_scores_and_clips(spark):
    rate = 1000
    t = np.arange(4 * rate) / rate
    x = np.where((t > 1) & (t < 1.5), np.sin(2 * np.pi * 100 * t), 0)
    rows = spark.createDataFrame([(1, x.tolist())], "k long, s array<double>")
    p = episodes.score(rows, ["k"], "s", 40).orderBy("frame").collect()
    assert len(p) == 100 and p[30]["p"] > 0.5 > p[10]["p"]
    found = episodes.extracted(rows, "k", "s", rate).collect()
    assert len(found) == 1 and abs(found[0]["begin"] - 950) < 40 and abs(found[0]["end"] - 1550) < 40


def test_painted(spark):
    rows = [("f", 0, 30, "UNK"), ("f", 10, 20, "POS"), ("f", 5, 9, "POS")]
    found = episodes.painted(spark.createDataFrame(rows, "f string, begin_us long, end_us long, q string"), "f", 10)
    assert {r["frame"]: r["label"] for r in found.collect()} == {0: 1, 1: 2, 2: 1}
