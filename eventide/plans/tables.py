"""Test tables as events: annotations and predictions drawn from `events`, and frames for run-length operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def collector() -> tuple[dict, dict, Callable]:
    """QUERIES, SQL and a decorator that enters a query under a name, with its DuckDB text if there is one."""
    queries: dict[str, Callable] = {}
    texts: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def enter(f):
            queries[name] = f
            if sql:
                texts[name] = sql
            return f

        return enter

    return queries, texts, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds from 2024-01-01 00:00, whatever the session's time zone."""
    days = F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).cast("long")
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    return days * 86_400_000_000 + clock.cast("long") * 1_000_000 + (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("long")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with an interval: file_id, event_id, begin_us, end_us, class, value."""
    events = table(spark, sf_dir, "events")
    begin = events.select(F.col("user_id").alias("file_id"), "event_id", micros("ts").alias("begin_us"), F.col("event_type").alias("class"), "value")
    return begin.withColumn("end_us", F.col("begin_us") + F.round(F.col("value") * 100).cast("long") * 6_000_000)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events but purchases, with q: UNK for errors, else POS."""
    rows = timed(spark, sf_dir).where("class <> 'purchase'")
    return rows.withColumn("q", F.when(F.col("class") == "error", "UNK").otherwise("POS"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, event_id, begin_us, end_us: most annotations, moved by up to 60 % of their length, and some purchases."""
    rows = timed(spark, sf_dir)
    shift = F.expr("((end_us - begin_us) * (event_id % 7)) div 10")
    moved = rows.where("class <> 'purchase' and event_id % 5 <> 0").select("file_id", "event_id", (F.col("begin_us") + shift).alias("begin_us"), (F.col("end_us") + shift).alias("end_us"))
    return moved.unionByName(rows.where("class = 'purchase' and event_id % 3 = 0").select("file_id", "event_id", "begin_us", "end_us"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, frame, p: the events of a user in order, with a score of three decimals."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), nth.cast("long").alias("frame"), (F.expr("(event_id * 2654435761) % 1000") / 1000.0).alias("p"), "event_id")


TIMED_SQL = """timed AS (
  SELECT user_id AS file_id, event_id, epoch_us(ts) - 1704067200000000 AS begin_us, event_type AS class, value,
    epoch_us(ts) - 1704067200000000 + cast(round(value * 100) AS BIGINT) * 6000000 AS end_us FROM events
), ann AS (
  SELECT *, CASE WHEN class = 'error' THEN 'UNK' ELSE 'POS' END AS q FROM timed WHERE class <> 'purchase'
), pred AS (
  SELECT file_id, event_id, begin_us + ((end_us - begin_us) * (event_id % 7)) // 10 AS begin_us, end_us + ((end_us - begin_us) * (event_id % 7)) // 10 AS end_us FROM ann WHERE event_id % 5 <> 0
  UNION ALL SELECT file_id, event_id, begin_us, end_us FROM timed WHERE class = 'purchase' AND event_id % 3 = 0
)"""
FRAMES_SQL = "frames AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, ((event_id * 2654435761) % 1000) / 1000.0::DOUBLE AS p, event_id FROM events)"
