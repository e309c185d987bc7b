"""Running maxima in two levels: a long group is cut into slices, so that no task orders the whole of it.

Each slice is scanned by itself; of each slice one number goes into a small scan over the slices of its group; and what
that gives is carried back into the slices. Islands, runs and holes need no other scan: in order of their begins, whether
a row starts an island depends on the largest end before it, and its island is known by the last begin that did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group from which it is cut, and the slices that a long group is cut into, of about as many rows each.
LONG, SLICES = 100_000, 256


def sliced(rows: DataFrame, by: list[str], at: str, long: int | None = None, slices: int | None = None) -> DataFrame:
    """rows with _by (the group, as a struct, in which nulls are equal) and _slice: rows with equal values of at are in one
    slice, and slices of a group are in the order of at.

    Groups of over `long` rows (LONG) are cut at approximate quantiles of at into `slices` (SLICES); others are slice 0."""
    long, slices = LONG if long is None else long, SLICES if slices is None else slices
    keyed = rows.withColumn("_by", F.struct(*by))
    quantiles = F.percentile_approx(at, [i / slices for i in range(1, slices)], 10 * slices)
    cuts = keyed.groupBy("_by").agg(F.count("*").alias("_n"), quantiles.alias("_cuts")).where(F.col("_n") > long).drop("_n")
    place = F.size(F.filter("_cuts", lambda c: c < F.col(at)))
    return keyed.join(cuts, "_by", "left").withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(place)).drop("_cuts")


def before(rows: DataFrame, order: list[str], name: str, value: Column, also: list[str] | None = None) -> DataFrame:
    """rows of sliced() with the largest value of the rows of the group before each; null for the first. The order starts
    with what slices go by; of rows that tie in it, some come first. also: columns that divide groups further."""
    by = ["_by", *(also or [])]
    own = rows.withColumn("_value", value)
    ahead = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    most = own.groupBy(*by, "_slice").agg(F.max("_value").alias("_most"))
    carried = most.select(*by, "_slice", F.max("_most").over(ahead).alias("_carried")).where("_carried is not null")
    within = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = own.withColumn("_own", F.max("_value").over(within))
    return scanned.join(carried, [*by, "_slice"], "left").withColumn(name, F.greatest("_own", "_carried")).drop("_value", "_own", "_carried")


def islands(rows: DataFrame, begin: str, end: str, most: Column | int = 0, also: list[str] | None = None) -> DataFrame:
    """rows of sliced() by begin, with _island: the begin of the first of the rows that follow each other with holes of at
    most `most` between the largest end so far and the next begin. Ends lie behind begins."""
    reached = before(rows, [begin, end], "_reach", F.col(end), also)
    joined = F.coalesce(F.col(begin) - F.col("_reach") <= most, F.lit(False))
    marked = before(reached.withColumn("_start", F.when(~joined, F.col(begin))), [begin, end], "_last", F.col("_start"), also)
    return marked.withColumn("_island", F.coalesce("_start", "_last")).drop("_reach", "_start", "_last")
