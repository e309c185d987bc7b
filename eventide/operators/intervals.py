"""Interval algebra over event tables (file, begin, end in integer ticks or microseconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.scans import islands, sliced


def first_k(events: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def kth_end(events: DataFrame, by: list[str], end: str, k: int, distinct: bool = False) -> DataFrame:
    """by and breakpoint: the kth smallest end of each group (of distinct ends if asked for); groups with fewer are out."""
    rows = events.select(*by, end)
    rows = rows.distinct() if distinct else rows
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(end))
    return rows.withColumn("_n", nth).where(F.col("_n") == k).select(*by, F.col(end).alias("breakpoint"))


def drop_shots(events: DataFrame, by: list[str], begin: str, end: str, is_positive: Column, k: int) -> DataFrame:
    """Rows that end after the kth positive row (by begin, then end) of their group; groups with fewer are out."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(begin, end))
    shot = events.where(is_positive).select(*by, begin, end).withColumn("_n", nth).where(F.col("_n") == k).select(*by, F.col(end).alias("_shot"))
    return events.join(shot, by).where(F.col(end) > F.col("_shot")).drop("_shot")


def split_at(events: DataFrame, breakpoints: DataFrame, by: list[str], end: str) -> DataFrame:
    """events with part: support up to the group's breakpoint, query behind it."""
    part = F.when(F.col(end) <= F.col("breakpoint"), "support").otherwise("query")
    return events.join(breakpoints, by).withColumn("part", part)


def overlaps(left: DataFrame, right: DataFrame, by: str, width: int) -> DataFrame:
    """Pairs of rows of equal `by` that share a point (closed bounds). Both sides have by, id, begin_us and end_us; the
    result has l_ and r_ columns.

    Intervals are cut at multiples of width and meet where they lie in one piece, so that a long file is shared by many
    tasks; a pair counts in the piece where the later of the two begins.
    """

    def pieces(df: DataFrame, prefix: str) -> DataFrame:
        named = df.select(F.col(by), *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != by))
        return named.withColumn("_piece", F.explode(F.sequence(F.floor(F.col(f"{prefix}begin_us") / width), F.floor(F.col(f"{prefix}end_us") / width))))

    a, b = pieces(left, "l_"), pieces(right, "r_")
    touch = (F.col("l_begin_us") <= F.col("r_end_us")) & (F.col("l_end_us") >= F.col("r_begin_us"))
    here = F.floor(F.greatest("l_begin_us", "r_begin_us") / width) == F.col("_piece")
    return a.join(b, [by, "_piece"]).where(touch & here).drop("_piece")


def iou(l_begin: Column, l_end: Column, r_begin: Column, r_end: Column) -> Column:
    """Intersection over union of two intervals; null for two equal points."""
    return F.try_divide((F.least(l_end, r_end) - F.greatest(l_begin, r_begin)).cast("double"), (F.greatest(l_end, r_end) - F.least(l_begin, r_begin)).cast("double"))


def iou_pairs(left: DataFrame, right: DataFrame, by: str, least: float, width: int) -> DataFrame:
    """Overlapping pairs whose intersection over union is above least, with iou."""
    found = overlaps(left, right, by, width)
    return found.withColumn("iou", iou(*(F.col(c) for c in ("l_begin_us", "l_end_us", "r_begin_us", "r_end_us")))).where(F.col("iou") > least)


def merged(events: DataFrame, by: list[str], begin: str, end: str, **carried: Column) -> DataFrame:
    """Islands of touching or overlapping intervals of each group; those that end where they begin are left out first.
    carried: aggregates over the rows of an island. A long group is scanned in slices."""
    rows = islands(sliced(events.where(F.col(end) > F.col(begin)), by, begin), begin, end)
    return rows.groupBy(*by, "_island").agg(F.min(begin).alias(begin), F.max(end).alias(end), *(c.alias(n) for n, c in carried.items())).drop("_island")


def ticks(micros: Column, rate: int) -> Column:
    """Whole ticks at `rate` a second of a time in microseconds."""
    return F.floor(micros * rate / 1_000_000)


def gaps(events: DataFrame, by: list[str], begin: str, end: str, start: Column) -> DataFrame:
    """The gap before each event of its group: from the end of the one before (start for the first) to its begin. The
    gap behind the last event is none of them."""
    before = F.lag(end).over(Window.partitionBy(*by).orderBy(begin, end, "event_id"))
    return events.withColumn("gap_begin", F.coalesce(before, start)).withColumn("gap_end", F.col(begin))


def background(gap_rows: DataFrame, half: int) -> DataFrame:
    """Gaps of positive length, cut to 2 * half around their centre."""
    rows = gap_rows.where("gap_end > gap_begin").withColumn("_centre", F.expr("gap_begin + (gap_end - gap_begin) div 2"))
    return rows.withColumn("gap_begin", F.greatest("gap_begin", F.col("_centre") - half)).withColumn("gap_end", F.least("gap_end", F.col("_centre") + half)).drop("_centre")


def chunked(files: DataFrame, by: str, until: str, length: int) -> DataFrame:
    """by, chunk, chunk_begin, chunk_end of the chunks that cover 0 to until; the last one ends there."""
    number = F.expr(f"greatest(0, ({until} + {length} - 1) div {length})")
    rows = files.where(number > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)))
    return rows.select(by, "chunk", (F.col("chunk") * length).alias("chunk_begin"), F.least((F.col("chunk") + 1) * length, F.col(until)).alias("chunk_end"))


def chunk_hits(chunks: DataFrame, events: DataFrame, by: str, begin: str, end: str, length: int) -> DataFrame:
    """chunks with n_events: events that begin in the chunk, end in it, or span it (from before it to its end on).

    Events are dealt to the chunks that they reach, and counted by an equi join.
    """
    reached = events.select(by, begin, end, F.explode(F.sequence(F.floor(F.col(begin) / length), F.floor(F.col(end) / length))).alias("chunk"))
    met = chunks.join(reached, [by, "chunk"], "left")
    inside = lambda c: (F.col(c) >= F.col("chunk_begin")) & (F.col(c) < F.col("chunk_end"))
    hit = inside(begin) | inside(end) | ((F.col(begin) < F.col("chunk_begin")) & (F.col(end) >= F.col("chunk_end")))
    return met.groupBy(by, "chunk", "chunk_begin", "chunk_end").agg(F.count_if(hit).alias("n_events"))


def self_overlaps(events: DataFrame, by: str, width: int) -> DataFrame:
    """Ordered pairs of different rows where the first begins or ends strictly inside the second, or spans it strictly;
    equal intervals are none."""
    rows = events.select(by, "event_id", "begin_us", "end_us")
    pairs = overlaps(rows, rows, by, width).where("l_event_id <> r_event_id")
    b, e, rb, re = (F.col(c) for c in ("l_begin_us", "l_end_us", "r_begin_us", "r_end_us"))
    return pairs.where(((b > rb) & (b < re)) | ((e > rb) & (e < re)) | ((b < rb) & (e > re)))


def followers(events: DataFrame, by: list[str], begin: str, within: int) -> Column:
    """Number of events of the group that begin less than `within` after a row, and not with it."""
    return F.count("*").over(Window.partitionBy(*by).orderBy(begin).rangeBetween(1, within - 1))


def cyclic_next(rows: DataFrame, by: list[str], order: list, value: str) -> Column:
    """The value of the next row of the group; of the first for the last."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.coalesce(F.lead(value).over(w), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def running_offset(rows: DataFrame, by: list[str], order: list, length: str) -> Column:
    """Sum of the lengths of the rows before, as files have them that are put one behind the other."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(w), F.lit(0))


def support_region(events: DataFrame, by: str, k: int, until: str) -> DataFrame:
    """Begin and end of the region of the first k events of each group: half way to the neighbours outside, or 0 and
    until. Groups with fewer events are out."""
    w = Window.partitionBy(by).orderBy("begin_us", "end_us", "event_id")
    rows = events.withColumn("_n", F.row_number().over(w))
    inside = F.col("_n") <= k
    found = rows.groupBy(by).agg(F.min(F.when(inside, F.col("begin_us"))).alias("first"), F.max(F.when(inside, F.col("end_us"))).alias("last"), F.min(F.when(~inside, F.col("begin_us"))).alias("next"), F.max(until).alias("_until"), F.count("*").alias("_m")).where(F.col("_m") >= k)
    behind = F.coalesce(F.greatest("next", "last"), F.col("_until"))
    return found.select(by, F.lit(0).cast("long").alias("region_begin"), F.floor((F.col("last") + behind) / 2).alias("region_end"))
