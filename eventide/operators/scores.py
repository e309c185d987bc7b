"""Precision, recall and F of detection counts, and their means over sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a score that would be zero, or undefined, is set to.
FLOOR = 1e-5


def precision(tp: Column, fp: Column) -> Column:
    return F.greatest(F.lit(FLOOR), F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(FLOOR)))


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp != 0, tp / (tp + fn)).otherwise(FLOOR)


def f_measure(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp != 0, tp / (tp + 0.5 * (fp + fn))).otherwise(FLOOR)


def scored(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall and f."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumn("precision", precision(tp, fp)).withColumn("recall", recall(tp, fn)).withColumn("f", f_measure(tp, fp, fn))


def summed(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def harmonic(value: str) -> Column:
    """The harmonic mean of a column over a group."""
    return F.count(value) / F.sum(1 / F.col(value))


def overall(sets: DataFrame) -> DataFrame:
    """One row: harmonic means over sets; F in percent with three decimals, halves to even."""
    return sets.agg(harmonic("precision").alias("precision"), harmonic("recall").alias("recall"), F.bround(100 * harmonic("f"), 3).alias("f_percent"))
