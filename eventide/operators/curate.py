"""Curation of catalogues: counts with bounds, lookups, samples, quotas and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequent(rows: DataFrame, by: list[str], least: int, most: int | None = None) -> DataFrame:
    """Groups with n rows, least <= n <= most."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found if most is None else found.where(F.col("n") <= most)


def frequent_or(rows: DataFrame, by: list[str], least: int, condition: Column, least_if: int) -> DataFrame:
    """Groups with `least` rows, or `least_if` rows that meet the condition: both counted in one pass."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(condition).alias("n_if"))
    return found.where((F.col("n") >= least) | (F.col("n_if") >= least_if))


def lookup(rows: DataFrame, table: DataFrame, on: list[str], value: str, default: Column, order: str) -> DataFrame:
    """rows with value from table; of keys that repeat there the last by order counts, missing ones get the default."""
    one = table.groupBy(*on).agg(F.max_by(value, order).alias(value))
    return rows.join(one, on, "left").withColumn(value, F.coalesce(value, default))


def strict_lookup(rows: DataFrame, table: DataFrame, on: list[str], value: str) -> DataFrame:
    """rows with value from table; running it fails on a key that is missing there."""
    found = rows.join(table.select(*on, value).withColumn("_there", F.lit(True)), on, "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.concat_ws("/", *on))).cast(table.schema[value].dataType)).otherwise(F.col(value))
    return found.withColumn(value, checked).drop("_there")


def mapped(column: Column, values: dict, strict: bool = True) -> Column:
    """A column's values by a fixed mapping; others fail, or are null."""
    out = F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), column)
    if not strict:
        return out
    return F.when(column.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("unmapped: "), column.cast("string"))).cast("string")).otherwise(out)


def shared_hash(key: str, seed: int) -> Column:
    """An order of integer keys that any engine with 64-bit integers has too; keys below 2^31."""
    return F.expr(f"({key} * 2654435761 + {seed}) % 4294967296")


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, in hash order of an integer key."""
    return rows.orderBy(shared_hash(key, seed), key).limit(n)


def sample_per_group(rows: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(shared_hash(key, seed), key))
    return rows.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.orderBy(shared_hash(key, seed), key)


def quotas(rows: DataFrame, by: str, key: str, each: int, capped: Column, cap: int, seed: int) -> DataFrame:
    """`each` rows of every group in hash order, and of rows that meet `capped` no more than cap in all."""
    few = sample_per_group(rows, [by], key, each, seed)
    some = few.where(capped).orderBy(shared_hash(key, seed), key).limit(cap)
    return few.where(~F.coalesce(capped, F.lit(False))).unionByName(some)


def split_in_groups(rows: DataFrame, by: list[str], key: str, sizes: list[tuple[str, int]], seed: int) -> DataFrame:
    """rows of each group in hash order, the first of them in the first part and so on; what is left over is dropped."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(shared_hash(key, seed), key))
    part, end = F.lit(None).cast("string"), sum(n for _, n in sizes)
    for name, n in reversed(sizes):
        part = F.when(F.col("_n") <= end, name).otherwise(part)
        end -= n
    return rows.withColumn("_n", nth).withColumn("part", part).drop("_n").where("part is not null")


def weighted_choice(uniform: Column, weights: list[tuple[str, float]]) -> Column:
    """A name by where a number in [0, 1) falls among the weights."""
    out, end = F.lit(weights[-1][0]), sum(w for _, w in weights[:-1])
    for name, w in reversed(weights[:-1]):
        out = F.when(uniform < round(end, 9), name).otherwise(out)
        end -= w
    return out


def unpivot_first(rows: DataFrame, keys: list[str], columns: list[str], wanted: list) -> DataFrame:
    """keys, class and q: the first column, in their order, that holds one of the wanted values."""
    hits = [F.when(F.col(c).isin(wanted), F.struct(F.lit(c).alias("class"), F.col(c).alias("q"))) for c in columns]
    return rows.select(*keys, F.coalesce(*hits).alias("h")).where("h is not null").select(*keys, "h.class", "h.q")


def fan_out(rows: DataFrame, keys: list[str], columns: list[str], positive, over: int) -> DataFrame:
    """One row for each class column, for classes with more than `over` positive values."""
    long = rows.unpivot(keys, columns, "class", "q")
    common = long.groupBy("class").agg(F.count_if(F.col("q") == positive).alias("_n")).where(F.col("_n") > over).select("class")
    return long.join(F.broadcast(common), "class")  # a row for each column


def best_detection(rows: DataFrame, by: list[str], label: str, score: str, order: str) -> DataFrame:
    """The label of the highest positive score of each group, the first by order of equal ones; ("", 0) if none is."""
    best = F.max(F.when(F.col(score) > 0, F.struct(F.col(score), -F.col(order), F.col(label))))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, F.coalesce(F.col(f"b.{label}"), F.lit("")).alias(label), F.coalesce(F.col(f"b.{score}"), F.lit(0.0)).alias(score))
