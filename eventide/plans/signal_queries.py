"""Signals as arrays: the embeddings play recordings of 64 samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.functions import columns as fn
from eventide.functions import signal
from eventide.functions.signal import mel_bank
from eventide.operators import extraction, resampling, separation, spectra, templates, vectors
from eventide.plans.tables import collector, micros, table

QUERIES, SQL, query = collector()


def clips(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def total(x):
    return F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")), 5)


@query("sig11_crop", "SELECT vec_id, round(list_sum((embedding::DOUBLE[])[(vec_id * 7) % 33 + 1 : (vec_id * 7) % 33 + 32]), 5) AS total FROM embeddings")
def crop(spark, d):
    return clips(spark, d).select("vec_id", total(fn.crop(F.col("embedding"), F.col("vec_id") * 7 % 33, 32)).alias("total"))


@query("sig11_stitch", "SELECT vec_id, 42 AS n, round(list_sum((embedding::DOUBLE[])[1:14]) + list_sum((embedding::DOUBLE[])[20:33]) + list_sum((embedding::DOUBLE[])[39:52]), 5) AS total FROM embeddings")
def stitch(spark, d):
    x = fn.stitched(F.col("embedding"), 52, 3, gap=5)
    return clips(spark, d).select("vec_id", F.size(x).alias("n"), total(x).alias("total"))


@query("sig11_tile", "SELECT vec_id, 150 AS n, round(2 * list_sum(embedding::DOUBLE[]) + list_sum((embedding::DOUBLE[])[1:22]), 5) AS total FROM embeddings")
def tile(spark, d):
    x = fn.tiled(F.col("embedding"), 150)
    return clips(spark, d).select("vec_id", F.size(x).alias("n"), total(x).alias("total"))


@query("sig12_speed", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, round(list_sum(list_transform(range(42), lambda i: x[floor(i * 1.5)::INT + 1] * (1 - (i * 1.5 - floor(i * 1.5))) + x[least(floor(i * 1.5)::INT + 2, 64)] * (i * 1.5 - floor(i * 1.5)))), 5) AS total, round(x[64], 5) AS first_backwards FROM e")
def speed(spark, d):
    x = F.col("embedding")
    return clips(spark, d).select("vec_id", total(fn.at_speed(x, 1.5)).alias("total"), F.round(F.element_at(F.reverse(x), 1).cast("double"), 5).alias("first_backwards"))


@query("sig17_segments", """WITH h AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) // 60000000 AS b, (epoch_us(ts) - 1704067200000000) // 60000000 + CASE event_id % 3 WHEN 0 THEN 400 WHEN 1 THEN 800 ELSE 1300 END - 1 AS e FROM events
), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h
), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR b > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, greatest(min(b) - 1, 0) * 60.0::DOUBLE AS begin_s, greatest(max(e) - 1, 0) * 60.0::DOUBLE AS end_s FROM g GROUP BY user_id, island""")
def segments(spark, d):
    """Events as detections of three templates, a frame a minute."""
    frames = F.when(F.col("event_id") % 3 == 0, 400).when(F.col("event_id") % 3 == 1, 800).otherwise(1300).cast("long")
    hits = table(spark, d, "events").select("user_id", F.floor(micros("ts") / 60_000_000).alias("frame"), frames.alias("frames"))
    return signal.painted_segments(hits, "user_id", rate=1, hop=60)


@query("sig19_mean_spectrum", """WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings
), g AS (SELECT label, i, avg(x * x) AS m FROM p GROUP BY label, i), w AS (SELECT i, avg(x * x) AS m FROM p GROUP BY i)
SELECT label, round(sum(g.m * w.m) / sqrt(sum(g.m * g.m)) / sqrt(sum(w.m * w.m)), 8) AS cosine FROM g JOIN w USING (i) GROUP BY label""")
def mean_spectrum(spark, d):
    """How like the mean power spectrum of each class is that of all recordings."""
    power = clips(spark, d).withColumn("power", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")))
    whole = vectors.mean_vectors(power, [], "power").select(F.col("power").alias("all"))
    classes = vectors.mean_vectors(power, ["label"], "power")
    return classes.join(F.broadcast(whole)).select("label", F.round(fn.cosine(F.col("power"), F.col("all")), 8).alias("cosine"))


@query("sig20_band_snr", """WITH f AS (SELECT vec_id, unnest(range(7)) AS t, embedding::DOUBLE[] AS x FROM embeddings
), b AS (SELECT vec_id, t, x, unnest([2, 3, 4, 5]) AS k FROM f
), s AS (SELECT vec_id, t, list_sum(list_transform(range(16), lambda i: x[8 * t + i + 1] * cos(2 * pi() * k * i / 16))) AS re, list_sum(list_transform(range(16), lambda i: x[8 * t + i + 1] * sin(2 * pi() * k * i / 16))) AS im FROM b
), e AS (SELECT vec_id, t, sum(re * re + im * im) AS energy FROM s GROUP BY vec_id, t
), a AS (SELECT vec_id, avg(energy) AS mean, quantile_cont(energy, 0.2) AS floor FROM e GROUP BY vec_id)
SELECT x.vec_id, round(10 * (log10(x.mean) - log10(y.floor)), 6) AS snr_db FROM a x JOIN a y ON y.vec_id = x.vec_id + 1""")
def band_snr(spark, d):
    """Every recording against the next one as its background, between 2 and 5 of 8 Hz."""

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"vec_id": part["vec_id"], "snr_db": [round(signal.band_snr(np.asarray(x, float), np.asarray(y, float), 16, 2, 5, 16, 8, whole=False), 6) for x, y in zip(part["embedding"], part["other"], strict=True)]})

    a = clips(spark, d).select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").mapInPandas(run, "vec_id long, snr_db double")


@query("sig21_overlap_add", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 5) AS total FROM embeddings")
def overlap_add(spark, d):
    """Framed with half overlap, and put together again."""
    back = signal.by_signal(clips(spark, d), ["vec_id"], "embedding", lambda x: np.abs(signal.overlap_added(signal.framed(x, 16, 8), 8, len(x))).sum(), "total")
    return back.withColumn("total", F.round("total", 5))


@query("sig23_normalise", "WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_avg(embedding::DOUBLE[]) AS m FROM embeddings), c AS (SELECT vec_id, list_transform(x, lambda v: v - m) AS x FROM s) SELECT vec_id, round(list_sum(list_transform(x, lambda v: abs(v))) / greatest(sqrt(list_avg(list_transform(x, lambda v: v * v))), 1e-6), 5) AS total FROM c")
def normalise(spark, d):
    return clips(spark, d).select("vec_id", total(F.transform(fn.normalised(F.col("embedding")), lambda x: F.abs(x))).alias("total"))


@query("sig23_noise", "SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE + 0.1 * sqrt(-2 * ln(((vec_id * 2654435761 + i * 40503) % 9973 + 0.5) / 9973)) * cos(2 * pi() * ((vec_id * 2654435761 + (i + 5000) * 40503) % 9973 + 0.5) / 9973))), 5) AS total FROM embeddings")
def noise(spark, d):
    return clips(spark, d).select("vec_id", total(fn.noisy(F.col("embedding"), F.col("vec_id"), 0.1)).alias("total"))


@query("sig25_pad", "SELECT vec_id, 76 AS n, round(embedding[1]::DOUBLE, 6) AS seventh, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def pad(spark, d):
    """Silence of 0.75 s at 8 Hz before and behind every recording."""
    x = fn.padded_by(F.col("embedding"), 6)
    return clips(spark, d).select("vec_id", F.size(x).alias("n"), F.round(F.element_at(x, 7), 6).alias("seventh"), total(x).alias("total"))


#: Spectra of frames of 16 samples, 8 apart, behind a Hann window, as DuckDB text: re and im by recording, frame and bin.
FRAMED_SQL = """f AS (SELECT vec_id, unnest(range(7)) AS t, embedding::DOUBLE[] AS x FROM embeddings
), b AS (SELECT vec_id, t, x, unnest(range(9)) AS k FROM f
), s AS (SELECT vec_id, t, k, list_sum(list_transform(range(16), lambda i: x[8 * t + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 15)) * cos(2 * pi() * k * i / 16))) AS re, list_sum(list_transform(range(16), lambda i: x[8 * t + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 15)) * sin(2 * pi() * k * i / 16))) AS im FROM b
)"""


@query("sig13_spectrogram", f"""WITH {FRAMED_SQL}, m AS (SELECT vec_id, t, k, sqrt(re * re + im * im) AS a FROM s
), d AS (SELECT vec_id, a - median(a) OVER (PARTITION BY vec_id, k) - median(a) OVER (PARTITION BY vec_id, t) AS a FROM m)
SELECT vec_id, round(sum(abs(a)), 5) AS total FROM d GROUP BY vec_id""")
def spectrogram(spark, d):
    """Magnitudes less the medians of their bin and of their frame."""
    made = signal.by_signal(clips(spark, d), ["vec_id"], "embedding", lambda x: np.abs(signal.spectrogram(x, 16, 8)).sum(), "total")
    return made.withColumn("total", F.round("total", 5))


@query("sig16_peaks", """WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings
), n AS (SELECT *, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS before, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS after FROM p)
SELECT vec_id, count(*) FILTER (x > before AND x >= after AND x >= 0.1)::DOUBLE AS n, coalesce(sum(i) FILTER (x > before AND x >= after AND x >= 0.1), 0)::DOUBLE AS places FROM n GROUP BY vec_id""")
def peaks(spark, d):
    """Local maxima of at least 0.1: their number and the sum of their places."""
    found = lambda x: signal.peaks(x, 0.1, 1)
    n = signal.by_signal(clips(spark, d), ["vec_id"], "embedding", lambda x: len(found(x)), "n")
    return n.join(signal.by_signal(clips(spark, d), ["vec_id"], "embedding", lambda x: found(x).sum(), "places"), "vec_id")


@query("sig18_peak_frequency", f"""WITH {FRAMED_SQL}, m AS (SELECT vec_id, t, arg_max(k, re * re + im * im) AS k FROM s WHERE k >= 3 GROUP BY vec_id, t)
SELECT vec_id, round(avg(k) / 2, 6) AS hz FROM m GROUP BY vec_id""")
def peak_frequency(spark, d):
    made = signal.by_signal(clips(spark, d), ["vec_id"], "embedding", lambda x: signal.peak_frequency(x, 8, 16, 8), "hz")
    return made.withColumn("hz", F.round("hz", 6))


@query("sig14_template", """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), w AS (SELECT a.vec_id, unnest(range(57)) AS i, a.x, b.x[21:28] AS t FROM p a JOIN p b ON b.vec_id = a.vec_id + 1
), c AS (SELECT vec_id, list_transform(x[i + 1 : i + 8], lambda v: v - list_avg(x[i + 1 : i + 8])) AS x, list_transform(t, lambda v: v - list_avg(t)) AS t FROM w)
SELECT vec_id, round(max(list_dot_product(x, t) / sqrt(list_dot_product(x, x) * list_dot_product(t, t))), 6) AS best FROM c GROUP BY vec_id""")
def template(spark, d):
    """The best correlation with eight samples of the next recording."""

    def run(parts):
        for part in parts:
            best = [signal.correlation(np.asarray(x, float)[None], np.asarray(y, float)[None, 20:28]).max() for x, y in zip(part["embedding"], part["other"], strict=True)]
            yield pd.DataFrame({"vec_id": part["vec_id"], "best": np.round(best, 6)})

    a = clips(spark, d).select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").mapInPandas(run, "vec_id long, best double")


@query("ml06_filter")
def quality_filter(spark, d):
    """A logistic regression of class 0 against the others on the even recordings, and its verdicts on the odd ones."""
    rows = clips(spark, d).withColumn("is", (F.col("label") == 0).cast("int"))
    model = vectors.fit_filter(rows.where("vec_id % 2 = 0"), "embedding", "is")
    return vectors.apply_filter(model, rows.where("vec_id % 2 = 1"), "embedding").select("vec_id", "label", "exclude")


#: Samples a second of the recordings below.
CLIP_RATE = 640
RESPONSE = extraction.response(CLIP_RATE)


def long_recordings(spark, d):
    """The vectors of a label one after another as a recording, in chunks of a vector; two of three are almost silent. Its
    stems are itself, and itself at half the height."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    level = F.when(F.col("vec_id") % 3 == 0, 1.0).otherwise(0.02)
    raw = clips(spark, d).select("label", nth.cast("long").alias("chunk"), F.transform("embedding", lambda x: x.cast("double") * level).alias("samples"))
    stems = raw.select("label", "chunk", F.explode(F.array(F.lit(1), F.lit(2))).alias("source"), "samples")
    return raw, stems.withColumn("samples", F.transform("samples", lambda x: x / F.col("source")))


@query("sig07_clips", f"""WITH c AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk, list_transform(embedding::DOUBLE[], lambda x: x * CASE WHEN vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.02::DOUBLE END) AS x FROM embeddings
), r AS (SELECT label, flatten(list(x ORDER BY chunk)) AS x FROM c GROUP BY label
), z AS (SELECT label, list_concat(list_transform(range({len(RESPONSE) - 1}), lambda i: 0.0::DOUBLE), x) AS padded, x, len(x) AS n FROM r
), f AS (SELECT label, n, x, list_transform(range(n), lambda i: pow(list_dot_product(padded[i + 1 : i + {len(RESPONSE)}], {[float(v) for v in RESPONSE[::-1]]!r}::DOUBLE[]), 2)) AS p FROM z
), g AS (SELECT label, n, x, list_concat(list_transform(range(5), lambda i: 0.0::DOUBLE), p, list_transform(range(5), lambda i: 0.0::DOUBLE)) AS p FROM f
), e AS (SELECT label, n, x, list_transform(range(n + 5), lambda i: sqrt(list_sum(p[i + 1 : i + 6]) / 6)) AS e FROM g
), s AS (SELECT label, n, x, e, list_min(e[65 : n + 5 - 64]) AS low, list_max(e[65 : n + 5 - 64]) AS high FROM e WHERE n + 5 > 128
), m AS (SELECT label, source, n, unnest(list_transform(range(n + 5), lambda i: struct_pack(i := i, up := (e[i + 1] / source - low) / (high - low + 1e-6) > 0.25))) AS u FROM s, (VALUES (1), (2)) AS v(source)
), k AS (SELECT label, source, n, u.i AS i, u.i - row_number() OVER (PARTITION BY label, source ORDER BY u.i) AS run FROM m WHERE u.up
), b AS (SELECT label, source, n, min(i) AS b, max(i) + 1 AS t FROM k GROUP BY label, source, n, run
), h AS (SELECT *, b - lag(t) OVER (PARTITION BY label, source ORDER BY b) AS hole FROM b
), j AS (SELECT *, sum(CASE WHEN hole <= 62 THEN 0 ELSE 1 END) OVER (PARTITION BY label, source ORDER BY b ROWS UNBOUNDED PRECEDING) AS island FROM h
), w AS (SELECT label, source, greatest(0, min(b) - 32) AS "begin", max(t) + 32 AS "end" FROM j GROUP BY label, source, island, n HAVING max(t) - min(b) >= 19 AND min(b) > 0 AND max(t) < n + 5
), y AS (SELECT w.*, x[greatest(0, "begin" - 32) + 1 : "end" + 32] AS x FROM w JOIN s USING (label)
) SELECT label, source, "begin"::BIGINT AS "begin", "end"::BIGINT AS "end", len(x) AS n, round(list_sum(list_transform(range(len(x)), lambda i: abs(x[i + 1] / source * least(1, i / 31.0::DOUBLE) * least(1, (len(x) - 1 - i) / 31.0::DOUBLE)))), 5) AS total FROM y""")
def clip_extraction(spark, d):
    """The clips of all stems with their samples, from stored chunks."""
    raw, stems = long_recordings(spark, d)
    found = extraction.clips(raw, stems, "label", "source", "samples", 64, CLIP_RATE)
    cut = extraction.clip_samples(stems, found, "label", "source", "samples", 64, CLIP_RATE)
    return cut.select("label", "source", "begin", "end", F.size("samples").cast("long").alias("n"), total(F.transform("samples", lambda x: F.abs(x))).alias("total"))


#: A window of 128 samples that adds up to 1 with itself half a block later.
WINDOW = [float(x) for x in 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(128) / 128)]


def separated_blocks(spark, d):
    """Every four vectors of a label one after another are 64 samples of four sources. Blocks of 128 samples, half a block
    apart, have the sources turned, and every third block backwards."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = clips(spark, d).select("label", nth.cast("long").alias("nth"), F.col("embedding").cast("array<double>").alias("x"))
    chunks = rows.groupBy("label", F.floor(F.col("nth") / 4).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "x"))), lambda r: r["x"]).alias("s")).where(F.size("s") == 4)
    after = chunks.select("label", (F.col("block") - 1).alias("block"), F.col("s").alias("t"))
    whole = chunks.join(after, ["label", "block"]).select("label", "block", F.zip_with("s", "t", lambda x, y: F.concat(x, y)).alias("s"))
    turn = F.col("label") * 7 + F.col("block") * F.col("block") + 3 * F.col("block")
    place = lambda j: F.pmod(F.when(F.col("block") % 3 == 0, turn - j).otherwise(turn + j), F.lit(4))
    return whole.select("label", "block", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get(F.col("s"), place(j).cast("int"))).alias("sources"))


@query("sig21_permutations", """WITH c AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS nth, embedding::DOUBLE[] AS x FROM embeddings
), z AS (SELECT label, count(*) // 4 AS n FROM c GROUP BY label
), s AS (SELECT label, nth // 4 AS chunk, ((label * 7 - nth % 4) % 4 + 4) % 4 AS source, x, n FROM c JOIN z USING (label) WHERE nth // 4 < n AND n > 1
), w AS (SELECT *, list_transform(range(64), lambda i: (CASE WHEN chunk < n - 1 THEN 0.5 - 0.5 * cos(2 * pi() * i / 128) ELSE 0 END) + (CASE WHEN chunk > 0 THEN 0.5 - 0.5 * cos(2 * pi() * (i + 64) / 128) ELSE 0 END)) AS w FROM s)
SELECT label, source, chunk, round(list_sum(list_transform(range(64), lambda i: abs(x[i + 1] * w[i + 1]))), 5) AS total FROM w""")
def permutations(spark, d):
    """The sources in the order that they have in the first block, block by block, added up."""
    whole = separation.resolved(separated_blocks(spark, d), ["label"], "sources", size=4)
    parts = separation.added_up(whole, ["label"], "sources", WINDOW)
    return parts.select("label", F.col("source").cast("long").alias("source"), "chunk", total(F.transform("samples", lambda x: F.abs(x))).alias("total"))


def template_recordings(spark, d):
    """The vectors of a label one after another as a spectrogram, a chunk of four frames of 16 bins each; and five supports
    of three to six frames at its beginning."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    frames = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: x.cast("double")))
    chunks = clips(spark, d).select("label", nth.cast("long").alias("chunk"), frames.alias("frames"))
    event = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("event")
    first = (F.col("event") * 9 + F.col("label") % 3).cast("long")
    supports = chunks.select("label").distinct().select("label", event).select("label", "event", first.alias("first"), (first + 3 + (F.col("label") + F.col("event")) % 4).alias("end"))
    return chunks, supports


@query("sig14_template_detector", """WITH RECURSIVE c AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 4 AS t, embedding::DOUBLE[] AS x FROM embeddings
), f AS (SELECT label, unnest(list_transform(range(4), lambda i: struct_pack(t := t + i, x := x[i * 16 + 1 : i * 16 + 16]))) AS f FROM c
), r AS (SELECT label, list(f.x ORDER BY f.t) AS fr, count(*) AS n FROM f GROUP BY label
), s AS (SELECT label, fr, n, e AS event, e * 9 + label % 3 AS first, e * 9 + label % 3 + 3 + (label + e) % 4 AS "end" FROM r, range(5) AS v(e)
), t AS (SELECT label, event, first, "end", "end" - first AS w, flatten(list_transform(range(first, "end"), lambda j: fr[j + 1][3 : 14])) AS x FROM s
), k AS (SELECT label, event, w, list_transform(x, lambda v: v - list_avg(x)) AS x FROM t
), own AS (SELECT a.label, a.x AS t, unnest(list_transform(range(b.w - a.w + 1), lambda i: b.x[i * 12 + 1 : (i + a.w) * 12])) AS x FROM k a JOIN (SELECT label, event, w, x FROM t) b ON a.label = b.label AND a.event <> b.event AND b.w >= a.w
), lim AS (SELECT label, max(list_dot_product(list_transform(x, lambda v: v - list_avg(x)), t) / sqrt(list_dot_product(t, t) * list_dot_product(list_transform(x, lambda v: v - list_avg(x)), list_transform(x, lambda v: v - list_avg(x))))) AS threshold FROM own GROUP BY label
), st AS (SELECT label, max("end") AS start FROM s GROUP BY label
), win AS (SELECT k.label, k.event, k.w, k.x AS t, start, n, unnest(list_transform(range(start, n - k.w + 1), lambda i: struct_pack(i := i, x := list_transform(range(5), lambda h: flatten(list_transform(range(k.w), lambda j: fr[i + j + 1][h + 1 : h + 12])))))) AS p FROM k JOIN r USING (label) JOIN st USING (label)
), sc AS (SELECT label, event, w, start, n, p.i AS i, list_max(list_transform(p.x, lambda x: list_dot_product(list_transform(x, lambda v: v - list_avg(x)), t) / sqrt(list_dot_product(t, t) * list_dot_product(list_transform(x, lambda v: v - list_avg(x)), list_transform(x, lambda v: v - list_avg(x)))))) AS c FROM win
), nb AS (SELECT *, lag(c) OVER (PARTITION BY label, event ORDER BY i) AS before, lead(c) OVER (PARTITION BY label, event ORDER BY i) AS after FROM sc
), pk AS (SELECT nb.label, event, w, i, row_number() OVER (PARTITION BY nb.label, event ORDER BY c DESC, i) AS nth FROM nb JOIN lim USING (label) WHERE c > before AND c >= after AND c >= threshold
), g(label, event, nth, kept) AS (SELECT DISTINCT label, event, 0::BIGINT, []::BIGINT[] FROM pk
  UNION ALL SELECT g.label, g.event, g.nth + 1, CASE WHEN len(list_filter(g.kept, lambda q: abs(q - pk.i) < pk.w)) = 0 THEN list_append(g.kept, pk.i) ELSE g.kept END FROM g JOIN pk ON pk.label = g.label AND pk.event = g.event AND pk.nth = g.nth + 1
), fin AS (SELECT label, event, unnest(kept) AS i FROM (SELECT *, row_number() OVER (PARTITION BY label, event ORDER BY nth DESC) AS z FROM g) WHERE z = 1
), seg AS (SELECT fin.label, i AS b, i + w - 1 AS e FROM fin JOIN (SELECT label, event, w FROM k) k ON k.label = fin.label AND k.event = fin.event
), m AS (SELECT *, max(e) OVER (PARTITION BY label ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg
), isle AS (SELECT *, sum(CASE WHEN reach IS NULL OR b > reach THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT label, round(greatest(min(b) - 1, 0) * 16.0::DOUBLE / 160, 6) AS begin_s, round(greatest(max(e) - 1, 0) * 16.0::DOUBLE / 160, 6) AS end_s FROM isle GROUP BY label, island""")
def template_detector(spark, d):
    """What the five supports of each recording find in the rest of it."""
    chunks, supports = template_recordings(spark, d)
    found = templates.detect(chunks, supports, "label", 4, 160, 16, 6)
    return found.select("label", F.round("begin_s", 6).alias("begin_s"), F.round("end_s", 6).alias("end_s"))


@query("sig06_long_envelopes", f"""WITH c AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk, list_transform(embedding::DOUBLE[], lambda x: x * CASE WHEN vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.02::DOUBLE END) AS x FROM embeddings
), z AS (SELECT label, list_concat(list_transform(range({len(RESPONSE) - 1}), lambda i: 0.0::DOUBLE), flatten(list(x ORDER BY chunk))) AS padded, 64 * count(*) AS n FROM c GROUP BY label
), f AS (SELECT label, n, list_transform(range(n), lambda i: pow(list_dot_product(padded[i + 1 : i + {len(RESPONSE)}], {[float(v) for v in RESPONSE[::-1]]!r}::DOUBLE[]), 2)) AS p FROM z
), g AS (SELECT label, n, list_concat(list_transform(range(5), lambda i: 0.0::DOUBLE), p, list_transform(range(5), lambda i: 0.0::DOUBLE)) AS p FROM f
), e AS (SELECT label, unnest(list_transform(range(n + 5), lambda i: struct_pack(chunk := least(i, n - 1) // 64, v := sqrt(list_sum(p[i + 1 : i + 6]) / 6)))) AS u FROM g)
SELECT label, u.chunk AS chunk, count(*) AS n, round(sum(u.v), 6) AS total FROM e GROUP BY label, u.chunk""")
def long_envelopes(spark, d):
    """The envelope of long recordings, high-pass included, chunk by chunk."""
    raw, _ = long_recordings(spark, d)
    found = spectra.envelopes(raw, ["label"], "samples", 64, CLIP_RATE)
    return found.select("label", "chunk", F.size("envelope").cast("long").alias("n"), F.round(F.aggregate("envelope", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


MEL = mel_bank(17, 640, 6, 20.0, 300.0)


@query("sig22_mel", f"""WITH r AS (SELECT label, flatten(list(embedding::DOUBLE[] ORDER BY vec_id)) AS x, 64 * count(*) AS n FROM embeddings GROUP BY label
), p AS (SELECT label, n, list_concat(list_reverse(x[2 : 17]), x, list_reverse(x[n - 16 : n - 1])) AS x FROM r
), f AS (SELECT label, unnest(range(n // 16 + 1)) AS frame, x FROM p
), w AS (SELECT label, frame, list_transform(range(32), lambda i: x[frame * 16 + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 32))) AS x FROM f
), s AS (SELECT label, frame, list_transform(range(17), lambda k: pow(list_sum(list_transform(range(32), lambda i: x[i + 1] * cos(2 * pi() * k * i / 32))), 2) + pow(list_sum(list_transform(range(32), lambda i: x[i + 1] * sin(2 * pi() * k * i / 32))), 2)) AS p FROM w
), m AS (SELECT label, frame, list_transform({[[float(v) for v in row] for row in MEL]!r}::DOUBLE[][], lambda b: 10 * log10(greatest(list_dot_product(b, p), 1e-10))) AS db FROM s
), e AS (SELECT label, max(list_max(db)) AS most, min(list_min(db)) AS least FROM m GROUP BY label)
SELECT label, frame, round(list_sum(list_transform(db, lambda v: (greatest(v, most - 80) + 79.6482) / (50.6842 + 79.6482) * 2 - 1)), 6) AS fixed,
  round(list_sum(list_transform(db, lambda v: (greatest(v, most - 80) - greatest(least, most - 80)) / (most - greatest(least, most - 80)) * 2 - 1)), 6) AS own FROM m JOIN e USING (label)""")
def mel(spark, d):
    """Mel spectra of long recordings in chunks, scaled to the model's range and to the recording's own."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    chunks = clips(spark, d).select("label", nth.cast("long").alias("chunk"), F.col("embedding").cast("array<double>").alias("samples"))
    frames = spectra.mel_frames(chunks, "label", "samples", 64, 640, 6, 32, 16, 20.0, 300.0)
    add = lambda df, name: df.select("label", "frame", F.round(F.aggregate("mel", F.lit(0.0), lambda s, x: s + x), 6).alias(name))
    return add(spectra.scaled(frames, "label"), "fixed").join(add(spectra.scaled(frames, "label", None), "own"), ["label", "frame"])


@query("sig18_flatness", f"""WITH {FRAMED_SQL}, p AS (SELECT vec_id, t, greatest(re * re + im * im, 1e-10) AS p FROM s
), d AS (SELECT vec_id, t, 10 * log10(exp(avg(ln(p))) / avg(p)) AS db FROM p GROUP BY vec_id, t)
SELECT vec_id, round(avg(db), 6) AS db FROM d GROUP BY vec_id""")
def flatness(spark, d):
    made = signal.by_signal(clips(spark, d), ["vec_id"], "embedding", lambda x: signal.mean_flatness_db(x, 16, 8), "db")
    return made.withColumn("db", F.round("db", 6))


@query("sig16_distant_peaks", """WITH RECURSIVE p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings
), n AS (SELECT *, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS before, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS after FROM p
), k AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS nth FROM n WHERE x > before AND x >= after AND x >= 0.05
), g(vec_id, nth, kept) AS (SELECT DISTINCT vec_id, 0::BIGINT, []::BIGINT[] FROM k
  UNION ALL SELECT g.vec_id, g.nth + 1, CASE WHEN len(list_filter(kept, lambda q: abs(q - k.i) < 5)) = 0 THEN list_append(kept, k.i) ELSE kept END FROM g JOIN k ON k.vec_id = g.vec_id AND k.nth = g.nth + 1
), z AS (SELECT vec_id, arg_max(kept, nth) AS kept FROM g GROUP BY vec_id)
SELECT vec_id, array_to_string(list_sort(coalesce(kept, [])), ',') AS places FROM (SELECT vec_id FROM embeddings) LEFT JOIN z USING (vec_id)""")
def distant_peaks(spark, d):
    """Local maxima of at least 0.05 that are five samples or more apart, the higher ones first."""

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"vec_id": part["vec_id"], "places": [",".join(map(str, signal.peaks(np.asarray(x, float), 0.05, 5))) for x in part["embedding"]]})

    return clips(spark, d).select("vec_id", "embedding").mapInPandas(run, "vec_id long, places string")


PHASES = resampling.phases(2, 3)


@query("sig12_resampled", f"""WITH r AS (SELECT label, flatten(list(embedding::DOUBLE[] ORDER BY vec_id)) AS x, 64 * count(*) AS n FROM embeddings GROUP BY label
), p AS (SELECT label, n, list_concat(list_transform(range({PHASES.shape[1] // 2}), lambda i: 0.0::DOUBLE), x, list_transform(range({PHASES.shape[1] // 2}), lambda i: 0.0::DOUBLE)) AS x FROM r
), y AS (SELECT label, unnest(list_transform(range((n * 2 + 2) // 3), lambda m: struct_pack(m := m, y := list_dot_product(x[m * 3 // 2 + 1 : m * 3 // 2 + {PHASES.shape[1]}], ({[[float(v) for v in row[::-1]] for row in PHASES]!r}::DOUBLE[][])[m * 3 % 2 + 1])))) AS u FROM p)
SELECT label, u.m * 3 // 2 // 64 AS chunk, min(u.m) AS first, count(*) AS n, round(sum(abs(u.y)), 5) AS total FROM y GROUP BY label, u.m * 3 // 2 // 64""")
def resampled(spark, d):
    """Long recordings at two thirds of their rate, chunk by chunk."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    chunks = clips(spark, d).select("label", nth.cast("long").alias("chunk"), F.col("embedding").cast("array<double>").alias("samples"))
    found = resampling.resampled(chunks, "label", "samples", 64, 96, 64)
    return found.select("label", "chunk", "first", F.size("samples").cast("long").alias("n"), total(F.transform("samples", lambda x: F.abs(x))).alias("total"))
