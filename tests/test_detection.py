import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import intervals, matching, runs, scores

US = 1_000_000


def events(spark, rows):
    return spark.createDataFrame([(f, i, int(b * US), int(e * US), q) for i, (f, b, e, q) in enumerate(rows)], "file_id string, event_id long, begin_us long, end_us long, q string")


def counted(spark, ref, est, **more):
    ref_df = events(spark, ref)
    est_df = events(spark, [(*e, "") for e in est]).drop("q")
    return {r["file_id"]: (r["tp"], r["fp"], r["fn"]) for r in matching.counts(ref_df, est_df, "file_id", F.col("q") == "POS", 0.3, 10 * US, **more).collect()}


def test_touching_events_do_not_match(spark):
    assert counted(spark, [("a", 0, 1, "POS")], [("a", 1, 2)]) == {"a": (0, 1, 1)}


def test_threshold_is_strict(spark):
    assert counted(spark, [("a", 0, 10, "POS")], [("a", 0, 3)]) == {"a": (0, 1, 1)}


def test_largest_matching(spark):
    assert counted(spark, [("a", 0, 10, "POS"), ("a", 4, 14, "POS")], [("a", 2, 12), ("a", 0, 9)]) == {"a": (2, 0, 0)}


def test_unknown_absorbs(spark):
    assert counted(spark, [("a", 0, 10, "UNK")], [("a", 0, 9)]) == {"a": (0, 0, 0)}


def test_file_without_estimates_misses_its_shots_too(spark):
    ref = [("a", i, i + 1, "POS") for i in range(7)] + [("b", i, i + 1, "POS") for i in range(7)]
    assert counted(spark, ref, [("b", 20, 21)], shots=5) == {"a": (0, 0, 7), "b": (0, 1, 2)}


def test_shots(spark):
    rows = [("a", i, i + 1, "POS") for i in range(5)] + [("a", 2, 3, "UNK"), ("a", 6, 7, "POS")]
    left = intervals.drop_shots(events(spark, rows), ["file_id"], "begin_us", "end_us", F.col("q") == "POS", 5)
    assert [r["begin_us"] for r in left.collect()] == [6 * US]


def brute_matching(edges):
    refs = sorted({r for r, _ in edges})
    best = 0
    for choice in itertools.product(*[[None, *[e for r2, e in edges if r2 == r]] for r in refs]):
        used = [c for c in choice if c is not None]
        if len(used) == len(set(used)):
            best = max(best, len(used))
    return best


def test_matching_is_largest():
    rng = random.Random(5)
    for _ in range(200):
        edges = list({((rng.randrange(5),), (rng.randrange(5),)) for _ in range(rng.randrange(1, 10))})
        found = matching.augment(edges)
        assert len({r for r, _ in found}) == len(found) == len({e for _, e in found})
        assert set(found) <= set(edges)
        assert len(found) == brute_matching(edges)


def test_overlaps_as_nested_loop(spark):
    rng = random.Random(1)
    rows = [("f", b := rng.uniform(0, 100), b + rng.uniform(0, 30), "POS") for _ in range(60)]
    a, b = events(spark, rows[:30]), events(spark, rows[30:])
    for width in (US, 7 * US, 1000 * US):
        got = {(r["l_event_id"], r["r_event_id"]) for r in intervals.overlaps(a, b, "file_id", width).collect()}
        want = {(x["event_id"], y["event_id"]) for x in a.collect() for y in b.collect() if x["begin_us"] <= y["end_us"] and x["end_us"] >= y["begin_us"]}
        assert got == want


def test_islands(spark):
    rows = [("a", 0, 1, "x"), ("a", 1, 2, "x"), ("a", 3, 4, "x"), ("a", 5, 5, "x")]
    found = intervals.merged(events(spark, rows), ["file_id", "q"], "begin_us", "end_us")
    assert sorted((r["begin_us"] // US, r["end_us"] // US) for r in found.collect()) == [(0, 2), (3, 4)]
    again = intervals.merged(found, ["file_id", "q"], "begin_us", "end_us")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def mask(spark, text):
    return spark.createDataFrame([("f", i, c == "1") for i, c in enumerate(text)], "file string, frame long, on boolean")


def painted(rows, n):
    out = np.zeros(n, int)
    for r in rows.collect():
        out[r["run_begin"] : r["run_end"]] = 1
    return "".join(map(str, out))


def test_holes_and_short_runs(spark):
    found = runs.runs(mask(spark, "0110110"), "file", "frame", F.col("on"))
    assert painted(runs.filled(found, ["file"], 1), 7) == "0111110"
    assert painted(runs.filled(found, ["file"], 0), 7) == "0110110"
    edges = runs.runs(mask(spark, "1110001111"), "file", "frame", F.col("on"))
    assert painted(runs.long_enough(edges, 2), 10) == "0" * 10
    open_run = runs.exported(runs.runs(mask(spark, "0011"), "file", "frame", F.col("on"))).collect()
    assert [(r["run_begin"], r["run_end"]) for r in open_run] == [(2, 3)]


def test_morphology_as_loop(spark):
    rng = random.Random(2)
    for _ in range(3):
        text = "".join(rng.choice("0111") for _ in range(60))
        found = runs.long_enough(runs.filled(runs.runs(mask(spark, text), "file", "frame", F.col("on")), ["file"], 2), 4)
        m = [c == "1" for c in text]
        i = 0
        while i < len(m):
            j = i
            while j < len(m) and not m[j]:
                j += 1
            if i and j < len(m) and i < j <= i + 2:
                m[i:j] = [True] * (j - i)
            i = max(j, i + 1)
        out, i = [0] * len(m), 0
        while i < len(m):
            j = i
            while j < len(m) and m[j]:
                j += 1
            if j - i >= 4 and i > 0 and j < len(m):
                out[i:j] = [1] * (j - i)
            i = max(j, i + 1)
        assert painted(found, 60) == "".join(map(str, out))


def test_one_support_event_gives_the_default(spark):
    frames = spark.createDataFrame([("f", i, 0.9 if 3 < i < 9 else 0.1) for i in range(20)], "file string, frame long, p double")
    support = spark.createDataFrame([("f", 0.2, None, 0.2)], "file string, mean_s double, std_s double, min_s double")
    assert [tuple(r) for r in runs.adaptive_threshold(frames, support, "file").collect()] == [("f", None, 0.0)]


def test_zero_scores(spark):
    found = scores.scored(spark.createDataFrame([(0, 0, 3)], "tp long, fp long, fn long")).collect()[0]
    assert (found["precision"], found["recall"], found["f"]) == (1e-5, 1e-5, 1e-5)


def test_published_harmonic_means(spark):
    """Precision and recall of eight sets as published, and the overall ones."""
    sets = [(0.0400, 0.1599), (0.2090, 0.5271), (0.8, 0.3077), (0.4231, 0.1687), (0.0062, 0.2609), (0.3525, 0.1469), (0.0061, 0.2228), (0.7365, 0.2123)]
    df = spark.createDataFrame([(p, r, 2 * p * r / (p + r)) for p, r in sets], "precision double, recall double, f double")
    found = scores.overall(df).collect()[0]
    assert found["precision"] == pytest.approx(0.02216, rel=0.01)
    assert found["recall"] == pytest.approx(0.21526, rel=0.01)
