"""Runs, thresholds, matching and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.operators import intervals as iv
from eventide.operators import episodes, matching, runs, scores
from eventide.plans.interval_queries import IOU_SQL, SHOTS_SQL, WIDTH
from eventide.plans.tables import FRAMES_SQL, TIMED_SQL, annotations, collector, frames, predictions, table

QUERIES, SQL, query = collector()

RUNS_SQL = f"""{FRAMES_SQL}, sizes AS (SELECT file_id, max(frame) + 1 AS n FROM frames GROUP BY file_id
), runs AS (
  SELECT file_id, min(frame) AS run_begin, max(frame) + 1 AS run_end, any_value(n) AS n FROM (SELECT file_id, frame, frame - row_number() OVER (PARTITION BY file_id ORDER BY frame) AS g FROM frames WHERE p >= 0.5) JOIN sizes USING (file_id) GROUP BY file_id, g
), filled AS (
  SELECT file_id, min(run_begin) AS run_begin, max(run_end) AS run_end, any_value(n) AS n FROM (
    SELECT *, sum(CASE WHEN hole <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY run_begin ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, run_begin - lag(run_end) OVER (PARTITION BY file_id ORDER BY run_begin) AS hole FROM runs)) GROUP BY file_id, g
)"""


def _runs(spark, d):
    return runs.runs(frames(spark, d), "file_id", "frame", F.col("p") >= 0.5)


@query("wn09_runs", f"WITH {RUNS_SQL} SELECT file_id, run_begin, least(run_end, n - 1) AS run_end, n FROM runs")
def exported(spark, d):
    return runs.exported(_runs(spark, d))


@query("wn10_fill", f"WITH {RUNS_SQL} SELECT * FROM filled")
def filled(spark, d):
    return runs.filled(_runs(spark, d), ["file_id"], 1)


@query("wn11_delete", f"WITH {RUNS_SQL} SELECT * FROM filled WHERE run_end - run_begin >= 3 AND run_begin > 0 AND run_end < n")
def deleted(spark, d):
    return runs.long_enough(runs.filled(_runs(spark, d), ["file_id"], 1), 3)


@query("sig01_maxpool", f"WITH {FRAMES_SQL} SELECT file_id, frame // 10 AS pool, max(p) AS p FROM frames GROUP BY file_id, frame // 10 HAVING count(*) = 10")
def maxpool(spark, d):
    return runs.pooled(frames(spark, d), "file_id", "frame", "p", 10)


WINDOWS_SQL = f"""{FRAMES_SQL}, windowed AS (
  SELECT f.file_id, frame, p, "window", frame - "window" * 10 AS place FROM (SELECT *, unnest(range(greatest(0, frame // 10 - 1), frame // 10 + 1)) AS "window" FROM frames) f
  JOIN (SELECT file_id, max(frame) + 1 AS n FROM frames GROUP BY file_id) s ON s.file_id = f.file_id WHERE "window" * 10 + 20 <= n
)"""


@query("wn15_windows", f'WITH {WINDOWS_SQL} SELECT file_id, "window", count(*) AS n, max(p) AS most, round(sum(p), 6) AS total FROM windowed GROUP BY file_id, "window"')
def windows(spark, d):
    found = runs.whole_windows(frames(spark, d), "file_id", "frame", 20)
    return found.groupBy("file_id", "window").agg(F.count("*").alias("n"), F.max("p").alias("most"), F.round(F.sum("p"), 6).alias("total"))


@query("wn16_stitch", f'WITH {WINDOWS_SQL} SELECT w.file_id, frame, "window", p FROM windowed w JOIN (SELECT file_id, max("window") AS last FROM windowed GROUP BY file_id) l ON l.file_id = w.file_id WHERE place >= 5 AND place < 15 OR "window" = 0 AND place < 5 OR "window" = last AND place >= 15')
def stitched(spark, d):
    found = runs.whole_windows(frames(spark, d), "file_id", "frame", 20)
    return runs.stitched(found, "file_id", 20).select("file_id", "frame", "window", "p")


GRID_SQL = "(VALUES " + ", ".join(f"({i}, {t!r}::DOUBLE, {p!r}::DOUBLE)" for i, (t, p) in enumerate(zip(runs.LOGITS, runs.THRESHOLDS, strict=True))) + ") AS grid(point, logit, threshold)"


@query("ml03_adaptive_threshold", f"""WITH {TIMED_SQL}, {FRAMES_SQL}, support AS (
  SELECT file_id, avg(s) AS mean_s, stddev_samp(s) AS std_s, floor(25 * least(greatest(0.5 * min(s), 0), 1)) AS hole, floor(25 * least(0.5, 0.5 * min(s))) AS least FROM (SELECT file_id, value / 1000.0 AS s, row_number() OVER (PARTITION BY file_id ORDER BY begin_us, event_id) n FROM ann WHERE q = 'POS') WHERE n <= 5 GROUP BY file_id
), lit AS (
  SELECT file_id, point, logit, frame, frame - row_number() OVER (PARTITION BY file_id, point ORDER BY frame) AS g FROM frames, {GRID_SQL} WHERE p >= threshold
), r AS (
  SELECT file_id, point, logit, min(frame) AS b, max(frame) + 1 AS e FROM lit GROUP BY file_id, point, logit, g
), h AS (
  SELECT *, b - lag(e) OVER (PARTITION BY file_id, point ORDER BY b) AS gap FROM r
), i AS (
  SELECT h.*, sum(CASE WHEN gap <= hole - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY h.file_id, point ORDER BY b ROWS UNBOUNDED PRECEDING) AS island FROM h JOIN support USING (file_id)
), m AS (
  SELECT file_id, point, logit, min(b) AS b, max(e) AS e FROM i GROUP BY file_id, point, logit, island
), s AS (
  SELECT m.file_id, point, logit, avg(exp(-0.5 * pow(((e - b) / 25 - mean_s) / std_s, 2))) * exp(-0.5 * logit * logit) AS score
  FROM m JOIN support USING (file_id) JOIN (SELECT file_id, max(frame) + 1 AS n FROM frames GROUP BY file_id) z USING (file_id) WHERE e - b >= least AND b > 0 AND e < n GROUP BY m.file_id, point, logit
)
SELECT support.file_id, round(score, 6) AS score, coalesce(logit, 0) AS logit FROM support LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, point) k FROM s WHERE score > 0.1) b ON b.file_id = support.file_id AND k = 1""")
def adaptive(spark, d):
    first = iv.first_k(annotations(spark, d).where("q = 'POS'"), ["file_id"], ["begin_us", "event_id"], 5).withColumn("s", F.col("value") / 1000.0)
    support = first.groupBy("file_id").agg(F.avg("s").alias("mean_s"), F.stddev_samp("s").alias("std_s"), F.min("s").alias("min_s"))
    return runs.adaptive_threshold(frames(spark, d), support, "file_id").withColumn("score", F.round("score", 6))


def _matched(spark, d):
    return matching.counts(annotations(spark, d), predictions(spark, d), "file_id", F.col("q") == "POS", 0.3, WIDTH, shots=5)


@query("jn10_matching")
def matched(spark, d):
    """A largest matching of all annotations with predictions, by file."""
    ref = annotations(spark, d).select("file_id", "event_id", "begin_us", "end_us")
    return matching.match(iv.iou_pairs(ref, predictions(spark, d), "file_id", 0.3, WIDTH), "file_id")


@query("jn11_match_counts")
def match_counts(spark, d):
    return _matched(spark, d)


def _with_set(counts):
    return counts.withColumn("set_id", F.concat(F.lit("S"), (F.col("file_id") % 8).cast("string")))


@query("ag05_scores_by_set")
def scores_by_set(spark, d):
    """Detection scores of every set of files, on matched counts."""
    return scores.scored(scores.summed(_with_set(_matched(spark, d)), ["set_id"]))


# Counts that SQL can say: a target is found if any prediction overlaps it enough, a prediction is false if none does.
HITS_SQL = f"""{SHOTS_SQL}, hit AS (
  SELECT r.file_id, r.event_id AS ref_id, e.event_id AS est_id FROM (SELECT * FROM ref WHERE q = 'POS') r JOIN pred e ON r.file_id = e.file_id AND r.begin_us <= e.end_us AND r.end_us >= e.begin_us WHERE {IOU_SQL} > 0.3
), counts AS (
  SELECT f.file_id, f.class, 'S' || (f.file_id % 8) AS set_id, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) - coalesce(n_hit, 0) AS fp, n_pos - coalesce(tp, 0) AS fn
  FROM (SELECT file_id, 'all' AS class, count(*) AS n_pos FROM ref WHERE q = 'POS' GROUP BY file_id) f
  LEFT JOIN (SELECT file_id, count(DISTINCT ref_id) AS tp, count(DISTINCT est_id) AS n_hit FROM hit GROUP BY file_id) h USING (file_id)
  LEFT JOIN (SELECT file_id, count(*) AS n_pred FROM pred GROUP BY file_id) p USING (file_id)
), scored AS (
  SELECT set_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts GROUP BY set_id
), by_set AS (
  SELECT *, greatest(1e-5, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 1e-5)) AS precision, CASE WHEN tp <> 0 THEN tp / (tp + fn) ELSE 1e-5 END AS recall, CASE WHEN tp <> 0 THEN tp / (tp + 0.5 * (fp + fn)) ELSE 1e-5 END AS f FROM scored
)"""


def _hits(spark, d):
    ref = iv.drop_shots(annotations(spark, d), ["file_id"], "begin_us", "end_us", F.col("q") == "POS", 5).where("q = 'POS'").select("file_id", "event_id", "begin_us", "end_us")
    est = predictions(spark, d)
    pairs = iv.iou_pairs(ref, est, "file_id", 0.3, WIDTH)
    hit = pairs.groupBy("file_id").agg(F.countDistinct("l_event_id").alias("tp"), F.countDistinct("r_event_id").alias("hit"))
    files = ref.groupBy("file_id").agg(F.count("*").alias("n_pos")).join(hit, "file_id", "left").join(est.groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left").na.fill(0)
    return _with_set(files.select("file_id", "tp", (F.col("n") - F.col("hit")).alias("fp"), (F.col("n_pos") - F.col("tp")).alias("fn")))


@query("jn15_hit_counts", f"WITH {TIMED_SQL}, {HITS_SQL} SELECT file_id, set_id, tp, fp, fn FROM counts")
def hit_counts(spark, d):
    return _hits(spark, d)


@query("ag05_rollup", f"WITH {TIMED_SQL}, {HITS_SQL} SELECT set_id, file_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts GROUP BY ROLLUP (set_id, file_id)")
def rollup(spark, d):
    return _hits(spark, d).rollup("set_id", "file_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


@query("ag05_scores_by_class", f"""WITH {TIMED_SQL}, {HITS_SQL}, c AS (SELECT set_id, 'C' || (file_id % 3) AS class, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts GROUP BY GROUPING SETS ((set_id, 'C' || (file_id % 3)), ('C' || (file_id % 3))))
SELECT set_id, class, tp, fp, fn, round(greatest(1e-5, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 1e-5)), 9) AS precision, round(CASE WHEN tp <> 0 THEN tp / (tp + fn) ELSE 1e-5 END, 9) AS recall, round(CASE WHEN tp <> 0 THEN tp / (tp + 0.5 * (fp + fn)) ELSE 1e-5 END, 9) AS f FROM c""")
def scores_by_class(spark, d):
    """Scores of each class of files in each set, and of each class in all sets."""
    rows = _hits(spark, d).withColumn("class", F.concat(F.lit("C"), (F.col("file_id") % 3).cast("string")))
    summed = rows.groupingSets([("set_id", "class"), ("class",)], "set_id", "class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return scores.scored(summed).select("set_id", "class", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f")))


@query("ag06_prf", f"WITH {TIMED_SQL}, {HITS_SQL} SELECT set_id, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f, 9) AS f FROM by_set")
def prf(spark, d):
    found = scores.scored(scores.summed(_hits(spark, d), ["set_id"]))
    return found.select("set_id", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f")))


@query("ag07_hmean", f"WITH {TIMED_SQL}, {HITS_SQL} SELECT round(count(*) / sum(1 / precision), 9) AS precision, round(count(*) / sum(1 / recall), 9) AS recall, round_even(100 * count(*) / sum(1 / f), 3) AS f_percent FROM by_set")
def hmean(spark, d):
    found = scores.overall(scores.scored(scores.summed(_hits(spark, d), ["set_id"])))
    return found.select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "f_percent")


@query("snk04_report", f"WITH {TIMED_SQL}, {HITS_SQL} SELECT set_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f FROM by_set")
def report(spark, d):
    """Scores written as one nested JSON text and read back from it."""
    found = scores.scored(scores.summed(_hits(spark, d), ["set_id"]))
    entry = F.struct("set_id", F.struct(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f"))).alias("s"))
    text = found.agg(F.to_json(F.struct(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("scores_per_subset"))).alias("json"))
    read = text.select(F.from_json("json", "scores_per_subset map<string, struct<precision: double, recall: double, f: double>>").alias("r"))
    return read.select(F.explode("r.scores_per_subset").alias("set_id", "s")).select("set_id", "s.precision", "s.recall", "s.f")


def _trailing():
    return Window.partitionBy("file_id").orderBy("frame").rowsBetween(-9, 0)


@query("ag21_trailing", f"WITH {FRAMES_SQL} SELECT file_id, frame, round(avg(p) OVER (PARTITION BY file_id ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS trailing FROM frames")
def trailing(spark, d):
    return frames(spark, d).select("file_id", "frame", F.round(F.avg("p").over(_trailing()), 6).alias("trailing"))


@query("sig02_raster", f"WITH {TIMED_SQL} SELECT file_id, frame, max(label) AS label FROM (SELECT file_id, unnest(range(begin_us // 3600000000, end_us // 3600000000)) AS frame, CASE WHEN q = 'POS' THEN 2 ELSE 1 END AS label FROM ann) GROUP BY file_id, frame")
def raster(spark, d):
    """Hours that events cover, with the larger label where they overlap."""
    return episodes.painted(annotations(spark, d), "file_id", 3_600_000_000)


@query("ml04_hard_supports", f"""WITH {TIMED_SQL}, {FRAMES_SQL}, c AS (
  SELECT file_id, frame // 5 AS chunk, max(p) AS p, count(*) FILTER (p > 0.95) AS n_events FROM frames GROUP BY file_id, frame // 5
) SELECT file_id, chunk, n_events, p FROM (SELECT *, row_number() OVER (PARTITION BY file_id, n_events > 0 ORDER BY p DESC, chunk DESC) AS n, sum((n_events > 0)::INT) OVER (PARTITION BY file_id) AS hits FROM c) WHERE n_events > 0 OR n <= greatest(0, 8 - hits)""")
def hard_supports(spark, d):
    chunks = frames(spark, d).groupBy("file_id", F.floor(F.col("frame") / 5).alias("chunk")).agg(F.max("p").alias("p"), F.count_if(F.col("p") > 0.95).alias("n_events"))
    return episodes.hard_supports(chunks, "file_id", 8).select("file_id", "chunk", "n_events", "p")


@query("rnd08_episodes")
def episode_plan(spark, d):
    """A thousand episodes over the documents, in clusters by source."""
    return episodes.plan(spark, 1000, table(spark, d, "documents"), "source", "doc_id", 5, 10)
