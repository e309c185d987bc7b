"""Interval queries over the annotation and prediction tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.operators import intervals as iv
from eventide.plans.tables import TIMED_SQL, annotations, collector, predictions

QUERIES, SQL, query = collector()
WITH = f"WITH {TIMED_SQL}"
#: Cut of intervals for range joins: three times the mean length of an event here.
WIDTH = 4 * 3_600_000_000
CHUNK = 3_600_000_000


@query("wn01_first_k", f"{WITH} SELECT file_id, event_id, begin_us FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY begin_us, event_id) n FROM ann WHERE q = 'POS') WHERE n <= 5")
def first_k(spark, d):
    return iv.first_k(annotations(spark, d).where("q = 'POS'"), ["file_id"], ["begin_us", "event_id"], 5).select("file_id", "event_id", "begin_us")


@query("wn02_breakpoint", f"{WITH} SELECT file_id, end_us AS breakpoint FROM (SELECT file_id, end_us, row_number() OVER (PARTITION BY file_id ORDER BY end_us) n FROM ann WHERE q = 'POS') WHERE n = 5")
def breakpoint_(spark, d):
    return iv.kth_end(annotations(spark, d).where("q = 'POS'"), ["file_id"], "end_us", 5)


@query("wn02_breakpoint_distinct", f"{WITH} SELECT file_id, end_us AS breakpoint FROM (SELECT file_id, end_us, row_number() OVER (PARTITION BY file_id ORDER BY end_us) n FROM (SELECT DISTINCT file_id, end_us FROM ann WHERE q = 'POS')) WHERE n = 5")
def breakpoint_distinct(spark, d):
    return iv.kth_end(annotations(spark, d).where("q = 'POS'"), ["file_id"], "end_us", 5, distinct=True)


SHOTS_SQL = """shot AS (
  SELECT file_id, end_us AS shot_us FROM (SELECT file_id, end_us, row_number() OVER (PARTITION BY file_id ORDER BY begin_us, end_us) n FROM ann WHERE q = 'POS') WHERE n = 5
), ref AS (SELECT ann.* FROM ann JOIN shot USING (file_id) WHERE end_us > shot_us)"""


@query("wn03_drop_shots", f"{WITH}, {SHOTS_SQL} SELECT file_id, event_id, q, begin_us, end_us FROM ref")
def drop_shots(spark, d):
    return iv.drop_shots(annotations(spark, d), ["file_id"], "begin_us", "end_us", F.col("q") == "POS", 5).select("file_id", "event_id", "q", "begin_us", "end_us")


@query("wn04_split", f"{WITH}, {SHOTS_SQL} SELECT file_id, event_id, CASE WHEN end_us <= b THEN 'support' ELSE 'query' END AS part FROM ann JOIN (SELECT file_id, end_us AS b FROM (SELECT file_id, end_us, row_number() OVER (PARTITION BY file_id ORDER BY end_us) n FROM ann WHERE q = 'POS') WHERE n = 5) USING (file_id)")
def split(spark, d):
    rows = annotations(spark, d)
    return iv.split_at(rows, iv.kth_end(rows.where("q = 'POS'"), ["file_id"], "end_us", 5), ["file_id"], "end_us").select("file_id", "event_id", "part")


ISLANDS = """SELECT *, sum(CASE WHEN reach IS NULL OR b > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, class ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, max(e) OVER (PARTITION BY file_id, class ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM (SELECT file_id, class, value, (begin_us * 2) // 125 AS b, (end_us * 2) // 125 AS e FROM ann) WHERE e > b)"""


def _ticks(rows):
    return rows.select("file_id", "class", "value", F.expr("(begin_us * 2) div 125").alias("begin_tick"), F.expr("(end_us * 2) div 125").alias("end_tick"))


@query("wn05_merge", f"{WITH} SELECT file_id, class, min(b) AS begin_tick, max(e) AS end_tick FROM ({ISLANDS}) GROUP BY file_id, class, island")
def merge(spark, d):
    return iv.merged(_ticks(annotations(spark, d)), ["file_id", "class"], "begin_tick", "end_tick")


@query("wn06_merge_freq", f"{WITH} SELECT file_id, class, min(b) AS begin_tick, max(e) AS end_tick, min(value) AS low_hz, max(value * 2) AS high_hz FROM ({ISLANDS}) GROUP BY file_id, class, island")
def merge_freq(spark, d):
    return iv.merged(_ticks(annotations(spark, d)), ["file_id", "class"], "begin_tick", "end_tick", low_hz=F.min("value"), high_hz=F.max(F.col("value") * 2))


FILES_SQL = "files AS (SELECT file_id, file_id % 8 AS set_id, max(end_us) AS duration_us FROM ann GROUP BY file_id)"


def _files(spark, d):
    return annotations(spark, d).groupBy("file_id").agg(F.max("end_us").alias("duration_us")).withColumn("set_id", F.col("file_id") % 8)


@query("wn07_concat_offset", f"{WITH}, {FILES_SQL} SELECT file_id, set_id, coalesce(sum(duration_us) OVER (PARTITION BY set_id ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_us FROM files")
def concat_offset(spark, d):
    files = _files(spark, d)
    return files.select("file_id", "set_id", iv.running_offset(files, ["set_id"], ["file_id"], "duration_us").alias("offset_us"))


@query("wn08_stride_offset", f"{WITH}, {FILES_SQL} SELECT file_id, set_id, (dense_rank() OVER (PARTITION BY set_id ORDER BY file_id) - 1) * 300000000 AS offset_us FROM files")
def stride_offset(spark, d):
    rank = F.dense_rank().over(Window.partitionBy("set_id").orderBy("file_id")) - 1
    return _files(spark, d).select("file_id", "set_id", (rank.cast("long") * 300_000_000).alias("offset_us"))


GAPS_SQL = "gaps AS (SELECT file_id, event_id, coalesce(lag(end_us) OVER (PARTITION BY file_id ORDER BY begin_us, end_us, event_id), 0) AS gap_begin, begin_us AS gap_end FROM ann)"


@query("wn12_gaps", f"{WITH}, {GAPS_SQL} SELECT * FROM gaps")
def gaps(spark, d):
    return iv.gaps(annotations(spark, d), ["file_id"], "begin_us", "end_us", F.lit(0)).select("file_id", "event_id", "gap_begin", "gap_end")


@query("prj21_background", f"{WITH}, {GAPS_SQL} SELECT file_id, event_id, greatest(gap_begin, gap_begin + (gap_end - gap_begin) // 2 - 500000) AS gap_begin, least(gap_end, gap_begin + (gap_end - gap_begin) // 2 + 500000) AS gap_end FROM gaps WHERE gap_end > gap_begin")
def background(spark, d):
    return iv.background(iv.gaps(annotations(spark, d), ["file_id"], "begin_us", "end_us", F.lit(0)), 500_000).select("file_id", "event_id", "gap_begin", "gap_end")


@query("wn18_support_region", f"{WITH} SELECT file_id, 0::BIGINT AS region_begin, floor((last + coalesce(greatest(next, last), until)) / 2)::BIGINT AS region_end FROM (SELECT file_id, max(end_us) FILTER (n <= 5) AS last, min(begin_us) FILTER (n > 5) AS next, max(end_us) AS until, count(*) AS m FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY begin_us, end_us, event_id) n FROM ann WHERE q = 'POS') GROUP BY file_id) WHERE m >= 5")
def support_region(spark, d):
    return iv.support_region(annotations(spark, d).where("q = 'POS'"), "file_id", 5, "end_us")


PAIRS = "SELECT r.file_id, r.event_id AS ref_id, e.event_id AS est_id, {value} FROM ann r JOIN pred e ON r.file_id = e.file_id AND r.begin_us <= e.end_us AND r.end_us >= e.begin_us"
IOU_SQL = "(least(r.end_us, e.end_us) - greatest(r.begin_us, e.begin_us))::DOUBLE / nullif(greatest(r.end_us, e.end_us) - least(r.begin_us, e.begin_us), 0)"


def _sides(spark, d):
    return annotations(spark, d).select("file_id", "event_id", "begin_us", "end_us"), predictions(spark, d)


@query("jn07_overlap", f"{WITH} {PAIRS.format(value='greatest(r.begin_us, e.begin_us) AS since')}")
def overlap(spark, d):
    ref, est = _sides(spark, d)
    found = iv.overlaps(ref, est, "file_id", WIDTH)
    return found.select("file_id", F.col("l_event_id").alias("ref_id"), F.col("r_event_id").alias("est_id"), F.greatest("l_begin_us", "r_begin_us").alias("since"))


@query("jn08_overlap_counts", f"{WITH} SELECT file_id, count(*) AS n_pairs FROM ({PAIRS.format(value='1')}) GROUP BY file_id")
def overlap_counts(spark, d):
    """The same pairs, counted: a plain join on the file with the bounds as a condition would meet all pairs of a file."""
    return iv.overlaps(*_sides(spark, d), "file_id", WIDTH).groupBy("file_id").agg(F.count("*").alias("n_pairs"))


@query("jn09_iou", f"{WITH} SELECT file_id, ref_id, est_id, round(iou, 6) AS iou FROM ({PAIRS.format(value=IOU_SQL + ' AS iou')}) WHERE iou > 0.3")
def iou(spark, d):
    found = iv.iou_pairs(*_sides(spark, d), "file_id", 0.3, WIDTH)
    return found.select("file_id", F.col("l_event_id").alias("ref_id"), F.col("r_event_id").alias("est_id"), F.round("iou", 6).alias("iou"))


CHUNKS_SQL = f"""until AS (SELECT file_id, max(end_us) + 100000 AS until_us FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY begin_us, event_id) n FROM ann WHERE q = 'POS') WHERE n <= 5 GROUP BY file_id
), chunks AS (
  SELECT file_id, chunk, chunk * {CHUNK} AS chunk_begin, least((chunk + 1) * {CHUNK}, until_us) AS chunk_end FROM (SELECT file_id, until_us, unnest(range((until_us + {CHUNK} - 1) // {CHUNK})) AS chunk FROM until)
), hits AS (
  SELECT c.file_id, chunk, chunk_begin, chunk_end, count(a.file_id) AS n_events FROM chunks c LEFT JOIN (SELECT * FROM ann WHERE q = 'POS') a ON a.file_id = c.file_id AND (a.begin_us >= chunk_begin AND a.begin_us < chunk_end OR a.end_us >= chunk_begin AND a.end_us < chunk_end OR a.begin_us < chunk_begin AND a.end_us >= chunk_end) GROUP BY ALL
)"""


def _chunks(spark, d):
    positive = annotations(spark, d).where("q = 'POS'")
    until = iv.first_k(positive, ["file_id"], ["begin_us", "event_id"], 5).groupBy("file_id").agg((F.max("end_us") + 100_000).alias("until_us"))
    return iv.chunk_hits(iv.chunked(until, "file_id", "until_us", CHUNK), positive, "file_id", "begin_us", "end_us", CHUNK)


@query("prj20_chunks", f"{WITH}, {CHUNKS_SQL} SELECT * FROM chunks")
def chunks(spark, d):
    return _chunks(spark, d).drop("n_events")


@query("jn12_chunk_hits", f"{WITH}, {CHUNKS_SQL} SELECT * FROM hits")
def chunk_hits(spark, d):
    return _chunks(spark, d)


@query("srt04_budget", f"{WITH}, {CHUNKS_SQL} SELECT file_id, chunk, n_events FROM (SELECT *, row_number() OVER (PARTITION BY file_id, n_events > 0 ORDER BY (chunk * 2654435761 + 7) % 4294967296, chunk) AS n, sum((n_events > 0)::INT) OVER (PARTITION BY file_id) AS hit FROM hits) WHERE n_events > 0 OR n <= greatest(0, 8 - hit)")
def budget(spark, d):
    """Chunks with events, all of them, and others in hash order up to eight in total."""
    hits = _chunks(spark, d)
    full = F.col("n_events") > 0
    nth = F.row_number().over(Window.partitionBy("file_id", full).orderBy(F.expr("(chunk * 2654435761 + 7) % 4294967296"), "chunk"))
    n_hit = F.sum(full.cast("long")).over(Window.partitionBy("file_id"))
    return hits.withColumn("_n", nth).withColumn("_hit", n_hit).where(full | (F.col("_n") <= F.greatest(F.lit(0), 8 - F.col("_hit")))).select("file_id", "chunk", "n_events")


@query("jn13_self_overlap", f"{WITH} SELECT a.file_id, a.event_id AS id, b.event_id AS other_id FROM ann a JOIN ann b ON a.file_id = b.file_id AND a.event_id <> b.event_id AND (a.begin_us > b.begin_us AND a.begin_us < b.end_us OR a.end_us > b.begin_us AND a.end_us < b.end_us OR a.begin_us < b.begin_us AND a.end_us > b.end_us)")
def self_overlap(spark, d):
    found = iv.self_overlaps(annotations(spark, d), "file_id", WIDTH)
    return found.select("file_id", F.col("l_event_id").alias("id"), F.col("r_event_id").alias("other_id"))


@query("jn14_next_within", f"{WITH} SELECT file_id, event_id, count(*) OVER (PARTITION BY file_id ORDER BY begin_us RANGE BETWEEN 1 FOLLOWING AND 86399999999 FOLLOWING) AS n_next FROM ann")
def next_within(spark, d):
    rows = annotations(spark, d)
    return rows.select("file_id", "event_id", iv.followers(rows, ["file_id"], "begin_us", 86_400_000_000).alias("n_next"))


@query("jn17_cyclic_pair", f"{WITH}, {FILES_SQL} SELECT file_id, set_id, coalesce(lead(file_id) OVER w, first_value(file_id) OVER w) AS other_id FROM files WINDOW w AS (PARTITION BY set_id ORDER BY (file_id * 2654435761 + 907) % 4294967296, file_id)")
def cyclic_pair(spark, d):
    files = _files(spark, d)
    order = [F.expr("(file_id * 2654435761 + 907) % 4294967296"), F.col("file_id")]
    return files.select("file_id", "set_id", iv.cyclic_next(files, ["set_id"], order, "file_id").alias("other_id"))


@query("prj15_rebase", f"{WITH}, {SHOTS_SQL} SELECT ann.file_id, event_id, begin_us - shot_us AS begin_us, end_us - shot_us AS end_us FROM ann JOIN shot USING (file_id) WHERE end_us > shot_us")
def rebase(spark, d):
    rows = annotations(spark, d)
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("begin_us", "end_us"))
    shot = rows.where("q = 'POS'").withColumn("n", nth).where("n = 5").select("file_id", F.col("end_us").alias("shot_us"))
    return rows.join(shot, "file_id").where("end_us > shot_us").select("file_id", "event_id", (F.col("begin_us") - F.col("shot_us")).alias("begin_us"), (F.col("end_us") - F.col("shot_us")).alias("end_us"))
