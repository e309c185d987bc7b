from pyspark.sql import functions as F

from eventide.operators.intervals import merged
from eventide.streaming import windows


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def stream(spark, sf_dir, tmp_path, columns):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns)
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), src


def test_counts_and_sessions(spark, sf_dir, tmp_path):
    live, still = stream(spark, sf_dir, tmp_path, [F.col("ts").cast("timestamp").alias("ts"), "event_type"])
    found = run(spark, windows.counts(live, "ts", "event_type", "1 day", "40 days"), "complete", "counted")
    assert sum(r["n"] for r in found) == still.count()
    found = run(spark, windows.sessions(live, "ts", "event_type", "1 hour", "40 days"), "complete", "sessions")
    assert sum(r["n"] for r in found) == still.count()


def test_islands_as_batch(spark, tmp_path):
    rows = [(1, 0, 5), (1, 4, 8), (1, 10, 12), (2, 0, 1), (2, 3, 4), (1, 20, 21), (2, 9, 10)]
    src = spark.createDataFrame(rows, "k long, begin_us long, end_us long")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    found = {tuple(r) for r in run(spark, windows.islands(live, "k", 0), "append", "islands")}
    whole = {tuple(r) for r in merged(src, ["k"], "begin_us", "end_us").select("k", "begin_us", "end_us").collect()}
    assert found == whole - {(1, 20, 21), (2, 9, 10)}
