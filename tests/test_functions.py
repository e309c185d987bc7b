import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions import columns as fn
from eventide.functions import signal
from eventide.operators import curate, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_paths(spark):
    p = F.lit("/a/b/c.d.wav")
    assert one(spark, fn.base_name(p)) == "c.d.wav"
    assert one(spark, fn.dir_name(p)) == "/a/b"
    assert one(spark, fn.stem(p)) == "c.d"
    assert one(spark, fn.suffix(p)) == ".wav"


def test_logarithms_of_zero_and_below(spark, tmp_path):
    """As in SQL, where the logarithm of zero is -Infinity and not null."""
    from eventide.plans.catalog_queries import QUERIES, SQL

    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, 0.0), (2, -1.5), (3, 100.0), (4, None)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    ours = {r["event_id"]: repr(r["a"]) for r in QUERIES["fn03_math"](spark, str(tmp_path)).collect()}
    assert ours == {1: "-inf", 2: "nan", 3: "2.0", 4: "None"}
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert {r[0]: repr(r[1]) for r in con.sql(SQL["fn03_math"]).fetchall()} == ours


def test_padding(spark):
    a = F.array(*(F.lit(float(i)) for i in range(3)))
    assert one(spark, fn.wrapped(a, 5)) == [0, 1, 2, 0, 1]
    assert one(spark, fn.wrapped(a, 3)) == [0, 1, 2]
    assert one(spark, fn.wrapped(a, 8)) == [0, 1, 2, 0, 1, 2, 0, 1]
    assert one(spark, fn.zero_padded(a, 2)) == [0, 1, 2, 0]
    assert one(spark, fn.padded_by(a, 1)) == [0, 0, 1, 2, 0]
    assert one(spark, fn.central(a, 1)) == [1]
    assert one(spark, fn.sized(a, 5)) == [0, 1, 2, 0, 0]


def test_strict_maps_fail(spark):
    rows = spark.createDataFrame([("a",), ("z",)], "k string")
    with pytest.raises(Exception, match="unmapped"):
        rows.select(curate.mapped(F.col("k"), {"a": "1"})).collect()
    with pytest.raises(Exception, match="no entry"):
        curate.strict_lookup(rows, spark.createDataFrame([("a", 1)], "k string, v int"), ["k"], "v").collect()


def test_lookup_takes_the_last_and_the_default(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    table = spark.createDataFrame([("a", True, 1), ("a", False, 2)], "k string, exclude boolean, row int")
    assert {r["k"]: r["exclude"] for r in curate.lookup(rows, table, ["k"], "exclude", F.lit(True), "row").collect()} == {"a": False, "b": True}


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumn("g", F.col("id") % 7)
    a = {r["id"] for r in curate.sample_per_group(rows.repartition(2), ["g"], "id", 5, 3).collect()}
    b = {r["id"] for r in curate.sample_per_group(rows.repartition(9), ["g"], "id", 5, 3).collect()}
    assert a == b and len(a) == 35


def test_best_detection_default(spark):
    rows = spark.createDataFrame([("a", "x", -1.0, 1), ("b", "y", 2.0, 1), ("b", "z", 2.0, 2)], "f string, label string, s double, ord int")
    assert sorted(tuple(r) for r in curate.best_detection(rows, ["f"], "label", "s", "ord").collect()) == [("a", "", 0.0), ("b", "y", 2.0)]


def test_filter_and_clusters(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("good", (F.col("embedding")[0] > 0).cast("int"))
    model = vectors.fit_filter(rows, "embedding", "good")
    right = vectors.apply_filter(model, rows, "embedding").where((F.col("good") == 0) == F.col("exclude")).count()
    assert right / rows.count() > 0.85
    assert len(vectors.fit_clusters(rows, "embedding", 100).clusterCenters()) == max(2, rows.count() // 100)


def test_nearest_refuses_large_tables(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FEW", 2)
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "k long, v array<double>")
    others = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "label long, o array<double>")
    with pytest.raises(ValueError):
        vectors.nearest(rows, "k", "v", others, "label", "o")


def test_envelope_and_peaks():
    rate = 2000
    t = np.arange(rate) / rate
    x = np.where((t > 0.4) & (t < 0.6), np.sin(2 * np.pi * 200 * t), 0)
    e = signal.envelope(x, rate, 20)
    assert len(e) == rate + 19
    assert e[1000] > 10 * e[100]
    assert signal.peaks(np.array([0, 1, 0, 3, 0, 2, 0.0]), 0.5, 3).tolist() == [3]
    assert signal.peaks(np.array([0, 1, 0, 3, 0, 2, 0.0]), 0.5, 2).tolist() == [1, 3, 5]


def test_frames_go_back():
    x = np.random.default_rng(0).standard_normal(1003)
    assert np.allclose(signal.overlap_added(signal.framed(x, 100, 50), 50, len(x)), x)


def test_template_is_found(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(20_000) * 0.01
    call = np.sin(2 * np.pi * 0.1 * np.arange(2048)) * np.hanning(2048)
    x[8192:10240] += call
    template = signal.spectrogram(x)[:, 32:39]
    rows = spark.createDataFrame([(1, x.tolist())], "k long, s array<double>")
    found = signal.template_detections(rows, "k", "s", [template], 0.8, 4).collect()
    assert any(abs(r["frame"] - 32) <= 1 for r in found)
    assert signal.adaptive_height([template, template])[0] == pytest.approx(1.0)


def test_numbers_by_signal(spark):
    x = np.sin(2 * np.pi * 1000 * np.arange(4000) / 8000)
    rows = spark.createDataFrame([(1, x.tolist())], "k long, s array<double>")
    found = signal.by_signal(rows, ["k"], "s", lambda v: signal.peak_frequency(v, 8000), "hz").collect()
    assert found[0]["hz"] == pytest.approx(1000, abs=20)
    assert signal.flatness_db(x) < -20
    assert signal.mel_db(x, 8000).max() == 1.0
    assert signal.above(rows, ["k"], "s", 8000, 80).count() == 4079


def test_high_pass_has_the_phase_of_the_filter():
    """Against the difference equation of a second-order filter, and the gain of the tenth order."""
    rate, cutoff = 1000, 50.0
    x = np.random.default_rng(0).standard_normal(400)
    c = np.tan(np.pi * cutoff / rate)
    a0 = 1 + np.sqrt(2) * c + c * c
    b, a = np.array([1, -2, 1]) / a0, np.array([2 * (c * c - 1), 1 - np.sqrt(2) * c + c * c]) / a0
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(3) if i >= k) - sum(a[k] * y[i - k - 1] for k in range(2) if i > k)
    assert np.allclose(signal.high_pass(x, rate, cutoff, order=2), y, atol=1e-9)
    t = np.arange(4 * rate) / rate
    low, high = (np.abs(signal.high_pass(np.sin(2 * np.pi * f * t), rate, 25.0))[2 * rate :].max() for f in (10, 100))
    assert low < 1e-3 and abs(high - 1) < 0.01


def test_templates_are_found_when_moved_by_bins():
    rng = np.random.default_rng(1)
    s = rng.standard_normal((40, 120))
    template = rng.standard_normal((40, 9))
    s[:, 50:59] = np.roll(template, 2, axis=0)
    plain, shifted = signal.correlation(s, template), signal.shifted_correlation(s, template)
    assert shifted.argmax() == 50 and shifted[50] == pytest.approx(1) and plain[50] < 0.5
    windows = [[np.corrcoef(s[k : k + 36, i : i + 9].ravel(), template[2:-2].ravel())[0, 1] for k in range(5)] for i in range(112)]
    assert np.allclose(shifted, np.max(windows, axis=1))


def test_painted_segments(spark):
    rows = spark.createDataFrame([("a", 0, 5, 1.0), ("a", 3, 5, 1.0), ("a", 20, 4, 1.0), ("a", 23, 1, 1.0), ("b", 7, 3, 1.0)], "k string, frame long, frames long, score double")
    got = sorted(tuple(r) for r in signal.painted_segments(rows, "k", rate=100, hop=50).collect())
    mask = {"a": np.zeros(40, int), "b": np.zeros(40, int)}
    for r in rows.collect():
        mask[r["k"]][r["frame"] : r["frame"] + r["frames"] - 1] = 1
    want = []
    for k, m in mask.items():
        edges = np.diff(np.concatenate([[0], m, [0]]))
        want += [(k, max(b - 1, 0) * 0.5, (e - 1) * 0.5) for b, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]
    assert got == sorted(want)


def test_band_snr_mel_and_permutations():
    rate, rng = 8000, np.random.default_rng(2)
    t = np.arange(rate) / rate
    noise = 0.01 * rng.standard_normal(rate)
    event = noise + np.sin(2 * np.pi * 1000 * t)
    assert signal.band_snr(event, noise, rate, 900, 1100) > 30 > 3 > abs(signal.band_snr(event, noise, rate, 2000, 3000))
    assert signal.band_snr(np.zeros(rate), noise, rate, 900, 1100) == -50 and signal.band_snr(event, np.zeros(rate), rate, 900, 1100) == 50
    assert np.isnan(signal.band_snr(event[:10], noise, rate, 0, 100, whole=False))
    mel = [signal.mean_mel(np.sin(2 * np.pi * f * t), rate) for f in (500, 510, 3000)]
    like = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert like(mel[0], mel[1]) > 0.8 > 0.2 > like(mel[0], mel[2])
    sources = rng.standard_normal((4, 200))
    for order in ((2, 0, 3, 1), (0, 1, 2, 3)):
        after = np.empty_like(sources)
        after[list(order)] = sources
        assert signal.permutation(sources, after + 0.1 * rng.standard_normal((4, 200))) == order


def test_vectors_of_no_length_win_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "k long, v array<double>")
    others = spark.createDataFrame([("none", [0.0, 0.0]), ("x", [2.0, 0.1]), ("y", [0.0, 3.0])], "label string, o array<double>")
    got = {r["k"]: (r["label"], round(r["score"], 3)) for r in vectors.nearest(rows, "k", "v", others, "label", "o").collect()}
    assert got == {1: ("x", 0.999), 2: ("none", 0.0)}
    got = {r["k"]: (r["label"], round(r["score"], 3)) for r in vectors.nearest(rows, "k", "v", others, "label", "o", "l2").collect()}
    assert got == {1: ("none", -1.0), 2: ("none", 0.0)}
