"""Sources and sinks: whole tables written by the writers to the shared folder, and read again by the readers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.plans.tables import collector, table
from eventide.sources import audio, ranges, readers, writers

QUERIES, SQL, query = collector()
EVENTS = "event_id long, user_id long, event_type string, value double"
RATE = 8


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


def written(spark, df, **how):
    """The folder that df was written to as delimited text."""
    path = writers.new_folder(spark)
    writers.table(df, path, **how)
    return path


@query("src01_snk01_csv", "SELECT event_id, user_id, event_type, value FROM events")
def csv(spark, d):
    return readers.delimited(spark, written(spark, events(spark, d)), EVENTS)


@query("src02_as_text", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS custkey, o_orderpriority FROM orders")
def as_text(spark, d):
    raw = readers.as_text(spark, written(spark, table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")))
    return raw.select("o_orderkey", F.col("o_custkey").cast("double").alias("custkey"), "o_orderpriority")


@query("src03_header", "SELECT 'f' || user_id || '.wav' AS file_id, value AS begin_s, value + 0.5 AS end_s FROM events")
def predictions(spark, d):
    rows = events(spark, d).select(F.concat(F.lit("f"), "user_id", F.lit(".wav")), "value", F.col("value") + 0.5).toDF(*readers.PREDICTION_HEADER)
    return readers.predictions(spark, written(spark, rows))


@query("src04_snk02_selection_tables", "SELECT user_id AS file_id, value AS begin_s, value + 1 AS end_s, event_type AS annotation, 1 AS channel FROM events")
def selection_tables(spark, d):
    """A folder of selection tables for each recording, read at once; the folder tells the recording."""
    path = writers.new_folder(spark)
    rows = events(spark, d).select(F.col("user_id").alias("file_id"), F.col("value").alias("begin_s"), (F.col("value") + 1).alias("end_s"), F.col("event_type").alias("annotation"))
    writers.selection_tables(rows, path)
    return readers.selection_table(spark, path, default_channel=1).select(F.col("file_id").cast("long").alias("file_id"), "begin_s", "end_s", "annotation", "channel")


@query("src05_headerless", "SELECT p_partkey AS key, p_name AS name FROM part")
def headerless(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    return readers.delimited(spark, written(spark, rows, header=False, sep="\t"), "key long, name string", sep="\t", header=False)


@query("src06_semicolons", "SELECT s_suppkey AS key, s_acctbal AS balance FROM supplier")
def semicolons(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return readers.delimited(spark, written(spark, rows, sep=";"), "key long, balance double", sep=";")


@query("src07_snk05_lists", "SELECT p_name AS value FROM part WHERE p_partkey % 10 <> 0")
def lists(spark, d):
    path = writers.new_folder(spark)
    padded = F.when(F.col("p_partkey") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit("  ")))
    writers.text_list(table(spark, d, "part").select(padded.alias("line")), "line", path)
    return readers.text_list(spark, path)


@query("src08_json_files", "SELECT 'f' || user_id AS file_id, event_id::DOUBLE / 1000 AS begin_s, (event_id::DOUBLE + 500) / 1000 AS end_s, event_type AS label FROM events")
def interval_json(spark, d):
    """A document for each recording: {file: [{start, end, label}]} in milliseconds."""
    path = writers.new_folder(spark)
    item = F.struct(F.col("event_id").cast("double").alias("start"), (F.col("event_id").cast("double") + 500).alias("end"), F.col("event_type").alias("label"))
    by_file = events(spark, d).groupBy(F.concat(F.lit("f"), "user_id").alias("file")).agg(F.collect_list(item).alias("items"))
    writers.documents(by_file.select("file", F.to_json(F.create_map("file", "items")).alias("json")), "file", "json", path)
    return readers.interval_json_file(spark, path)


@query("src09_metadata", "SELECT DISTINCT 'D' || (user_id % 3) AS dataset, 'S' || (user_id % 8) AS set_id, event_type AS class, 'f' || user_id AS file_id FROM events")
def metadata(spark, d):
    """A document for each dataset: {dataset: {set: {class: [file]}}}."""

    def named(k, v):
        return F.map_from_entries(F.collect_list(F.struct(k, v)))

    path = writers.new_folder(spark)
    rows = events(spark, d).select(F.concat(F.lit("D"), F.col("user_id") % 3).alias("dataset"), F.concat(F.lit("S"), F.col("user_id") % 8).alias("set_id"), F.col("event_type").alias("class"), F.concat(F.lit("f"), "user_id").alias("file_id"))
    classes = rows.groupBy("dataset", "set_id", "class").agg(F.collect_set("file_id").alias("files"))
    sets = classes.groupBy("dataset", "set_id").agg(named("class", "files").alias("classes")).groupBy("dataset").agg(named("set_id", "classes").alias("sets"))
    writers.documents(sets.select("dataset", F.to_json(F.create_map("dataset", "sets")).alias("json")), "dataset", "json", path)
    return readers.set_metadata(spark, path)


@query("src10_snk04_report", "SELECT CAST(user_id AS VARCHAR) AS file_id, count(*)::DOUBLE AS tp, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::DOUBLE AS fp FROM events GROUP BY user_id")
def report(spark, d):
    """A report written as text, and the scores of its files read from it."""
    path = writers.new_folder(spark)
    counted = [F.count("*").cast("double").alias("tp"), F.sum(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("fp")]
    rows = events(spark, d)
    text = writers.report_json(rows.agg(*counted), rows.groupBy((F.col("user_id") % 8).alias("subset")).agg(*counted), rows.groupBy("user_id").agg(*counted), "team", "EVAL")
    text.write.text(path)
    return readers.report_scores(spark, path).select("file_id", F.col("scores")["tp"].alias("tp"), F.col("scores")["fp"].alias("fp"))


@query("src12_listing", "SELECT 'subset=S' || (user_id % 8) AS folder, 1 AS n FROM events GROUP BY user_id % 8")
def listing(spark, d):
    path = writers.new_folder(spark)
    rows = events(spark, d).withColumn("subset", F.concat(F.lit("S"), F.col("user_id") % 8))
    rows.repartition("subset").write.partitionBy("subset").csv(path, header=True)
    return readers.listing(spark, path, "*.csv").groupBy("folder").agg(F.count("*").cast("int").alias("n"))


@query("src13_subsets", "SELECT 'S' || (user_id % 8) AS subset, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY user_id % 8")
def subsets(spark, d):
    """Rows of files below folders of subsets: the index from file to subset tells where each belongs."""
    path = writers.new_folder(spark)
    rows = events(spark, d).withColumn("subset", F.concat(F.lit("S"), F.col("user_id") % 8))
    rows.repartition("subset").write.partitionBy("subset").csv(path, header=True)
    index = readers.subsets(readers.listing(spark, path, "*.csv"))
    read = spark.read.option("recursiveFileLookup", "true").schema(EVENTS).csv(path, header=True).select("event_id", F.regexp_extract(F.col("_metadata.file_path"), "([^/]*/[^/]*)$", 1).alias("file"))
    return read.join(index, "file").groupBy("subset").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


def recorded(spark, d, told_rate=None, channels=1):
    """The embeddings as WAV files of 8 samples a second: path and content, stored in the shared folder. With two
    channels the second is the first one backwards."""

    def make(parts):
        for part in parts:
            wavs = []
            for x in part["embedding"]:
                x = np.asarray(x, float)
                wavs.append(audio.encode(x if channels == 1 else np.stack([x, x[::-1]], 1), RATE, told_rate))
            yield pd.DataFrame({"path": part["path"], "content": wavs})

    path = writers.new_folder(spark)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), "embedding")
    rows.mapInPandas(make, "path string, content binary").write.parquet(path)
    return spark.read.parquet(path)


PCM = "list_transform(embedding, lambda x: round_even(x::DOUBLE * 32768, 0) / 32768)"


@query("src14_snk07_decode", f"WITH q AS (SELECT vec_id, {PCM} AS q FROM embeddings), c AS (SELECT vec_id, list_avg(q) AS m, q FROM q) SELECT CAST(vec_id AS VARCHAR) AS path, 8 AS rate, 64 AS n, round(list_sum(list_transform(q, lambda x: abs((x - m)::FLOAT)::DOUBLE)), 6) AS total FROM c")
def decode(spark, d):
    whole = audio.cut(recorded(spark, d))
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return whole.select("path", F.col("sample_rate").alias("rate"), F.size("samples").alias("n"), F.round(total, 6).alias("total"))


@query("src15_snk13_excerpt", f"WITH q AS (SELECT vec_id, {PCM} AS q FROM embeddings), c AS (SELECT vec_id, list_avg(q) AS m, q FROM q) SELECT CAST(vec_id AS VARCHAR) AS path, 28 AS n, round(list_sum(list_transform(q[13:40], lambda x: abs((x - m)::FLOAT)::DOUBLE)), 6) AS total FROM c")
def excerpt(spark, d):
    """From 1.5 s to 5 s of every recording, from stored chunks of two seconds."""
    path = writers.new_folder(spark)
    audio.cut(recorded(spark, d), seconds=2).write.parquet(path)
    part = audio.excerpt(spark.read.parquet(path), 1.5, 5.0, seconds=2)
    return part.select("path", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), 6).alias("total"))


@query("src16_durations", "SELECT CAST(vec_id AS VARCHAR) AS path, 4 AS sample_rate, 16.0::DOUBLE AS duration_sec FROM embeddings")
def durations(spark, d):
    """Headers that tell half the rate make recordings twice as long."""
    return audio.probed(recorded(spark, d, told_rate=RATE // 2)).select("path", "sample_rate", "duration_sec")


@query("src19_channel", f"WITH q AS (SELECT vec_id, list_reverse({PCM}) AS q FROM embeddings), c AS (SELECT vec_id, list_avg(q) AS m, q FROM q) SELECT CAST(vec_id AS VARCHAR) AS path, round((q[1] - m)::FLOAT::DOUBLE, 6) AS first, round((q[64] - m)::FLOAT::DOUBLE, 6) AS last FROM c")
def channel(spark, d):
    x = F.col("samples")
    return audio.cut(recorded(spark, d, channels=2), channel=1).select("path", F.round(F.element_at(x, 1).cast("double"), 6).alias("first"), F.round(F.element_at(x, -1).cast("double"), 6).alias("last"))


@query("snk03_tables_of_manifest", "SELECT 'r' || (user_id % 20) AS recording, event_type AS annotation, count(*) AS n FROM events GROUP BY user_id % 20, event_type")
def tables_of_manifest(spark, d):
    """One long table as a selection table for each recording that a manifest names."""
    path = writers.new_folder(spark)
    rows = events(spark, d).select(F.concat(F.lit("r"), F.col("user_id") % 20).alias("recording"), F.col("value").alias("begin_s"), F.col("event_type").alias("annotation"))
    writers.selection_tables(rows, path, by="recording")
    return readers.selection_table(spark, path).groupBy("recording", "annotation").agg(F.count("*").alias("n"))


@query("snk06_manifest", "SELECT 'audio/' || user_id || '.wav' AS audio_fp, 'tables/' || user_id || '.txt' AS selection_table_fp FROM events GROUP BY user_id")
def manifest(spark, d):
    rows = events(spark, d).select("user_id").distinct()
    named = rows.select(F.format_string("audio/%d.wav", "user_id").alias("audio_fp"), F.format_string("tables/%d.txt", "user_id").alias("selection_table_fp"))
    return readers.delimited(spark, written(spark, named), "audio_fp string, selection_table_fp string")


@query("snk08_resumable", "SELECT event_id, value * 2 AS twice FROM events")
def resumable(spark, d):
    """Three shares of four are there when the job starts again; only the other one is made."""
    path, rows = writers.new_folder(spark), events(spark, d)
    make = lambda part: part.select("event_id", (F.col("value") * 2).alias("twice"))
    for i in range(3):
        make(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i)).write.parquet(f"{path}/share={i}")
    if writers.resumable(rows, "event_id", path, 4, make) != 1:
        raise RuntimeError("finished shares were made again")
    return spark.read.parquet(path).select("event_id", "twice")


@query("snk12_commands", "SELECT 'cut --file ' || event_type || ' --id ' || event_id || ' --times ' || (user_id % 7) AS value FROM events")
def commands(spark, d):
    path = writers.new_folder(spark)
    lines = writers.commands(events(spark, d).withColumn("times", F.col("user_id") % 7), "cut --file %s --id %d --times %d", ["event_type", "event_id", "times"])
    writers.text_list(lines, "value", path)
    return readers.text_list(spark, path)


@query("snk13_excerpt_table", "SELECT event_id, greatest(event_id, 500) - 500 AS begin_s, least(event_id + 30, 540) - 500 AS end_s FROM events WHERE event_id < 540 AND event_id + 30 > 500")
def excerpt_table(spark, d):
    """The events that touch an excerpt of 40 s, cut and with times from its start."""
    rows = events(spark, d).select("event_id", F.col("event_id").alias("begin_s"), (F.col("event_id") + 30).alias("end_s"))
    return writers.excerpt_table(rows, "begin_s", "end_s", F.lit(500), F.lit(40))


LONG_RATE = 64
#: Bytes that a task reads below: the recordings are of some hundred kilobytes at most, and still many tasks'.
LONG_RANGE = 4096


def long_recordings(spark, d):
    """The vectors of each label one after another as a WAV file of some length: the folder."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    path = writers.new_folder(spark)
    rows = table(spark, d, "embeddings").select(F.format_string("r%d", "label").alias("recording"), nth.cast("long").alias("chunk"), F.col("embedding").cast("array<double>").alias("samples"))
    ranges.write_wav(rows, "recording", "samples", path, LONG_RATE).write.format("noop").mode("overwrite").save()
    return path


def recording():
    return F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("recording")


LONG_SQL = "q AS (SELECT 'r' || label AS recording, flatten(list(list_transform(embedding, lambda x: round_even(greatest(-1, least(1 - 1.0 / 32768, x::DOUBLE)) * 32768, 0) / 32768) ORDER BY vec_id)) AS q FROM embeddings GROUP BY label)"


@query("src14_long_files", f"WITH {LONG_SQL} SELECT recording, (len(q) + 159) // 160 AS chunks, len(q) AS n, round(list_sum(list_transform(q, lambda x: abs(x - list_avg(q)))), 5) AS total FROM q")
def long_files(spark, d):
    """Long files in chunks of 2.5 s, read by ranges, without the mean of each recording."""
    whole = ranges.centred(ranges.wav(spark, long_recordings(spark, d), seconds=2.5, range_bytes=LONG_RANGE))
    total = F.sum(F.aggregate("samples", F.lit(0.0), lambda s, x: s + F.abs(x)))
    return whole.groupBy(recording()).agg(F.count("*").alias("chunks"), F.sum(F.size("samples")).alias("n"), F.round(total, 5).alias("total"))


@query("src15_long_excerpt", f"WITH {LONG_SQL} SELECT recording, len(q[197 : 560]) AS n, round(list_sum(list_transform(q[197 : 560], lambda x: abs(x))), 5) AS total FROM q WHERE len(q) > 196")
def long_excerpt(spark, d):
    """From 196 / 64 s to 8.75 s of long files: only the chunks between are read."""
    part = ranges.excerpts(ranges.wav(spark, long_recordings(spark, d), seconds=1, range_bytes=LONG_RANGE), 196 / LONG_RATE, 8.75, 1)
    return part.select(recording(), F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("total"))


@query("src16_long_durations", f"WITH {LONG_SQL} SELECT recording, 64 AS sample_rate, 1 AS channels, len(q) AS frames, len(q) / 64.0::DOUBLE AS duration_sec FROM q")
def long_durations(spark, d):
    return ranges.wav_heads(spark, long_recordings(spark, d)).select(recording(), "sample_rate", "channels", "frames", "duration_sec")


@query("src18_npy", "SELECT vec_id % 4 AS file, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS row, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings QUALIFY row >= 7")
def npy(spark, d):
    """The vectors as four matrices, of which all rows but the first seven are read, by ranges."""
    path = writers.new_folder(spark)
    writers.matrices(table(spark, d, "embeddings").withColumn("file", F.col("vec_id") % 4), "file", "vec_id", "embedding", path).write.format("noop").mode("overwrite").save()
    read = ranges.npy(spark, path, range_bytes=LONG_RANGE).where("row >= 7")
    return read.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).cast("long").alias("file"), "row", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
