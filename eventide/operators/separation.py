"""Separated sources, block by block: put into one order along a recording, and added up.

Blocks overlap by half. A separator gives the sources of each block in an order of its own. Neighbouring blocks tell which
source of the one is which of the other, each pair by itself; the orders along a recording are what these permutations
compose to, and as composition is associative, they are composed in a tree: blocks in slices, slices in slices of slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.shared import materialize

#: Permutations that one task composes one after another.
SLICE = 1024


def assignment(gain: np.ndarray) -> np.ndarray:
    """For each row of a square matrix a column of its own, with the largest sum, by shortest augmenting paths with
    potentials: a number of steps that grows with the cube of the size."""
    n = len(gain)
    cost = gain.max(initial=0.0) - gain
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)  # owner: the row of each column; the last is none
    for row in range(n):
        owner[n], column = row, n
        least, came, seen = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while owner[column] >= 0:
            seen[column] = True
            free = ~seen[:n]
            reduced = cost[owner[column]] - u[owner[column]] - v[:n]
            better = free & (reduced < least)
            least[better], came[better] = reduced[better], column
            following = int(np.argmin(np.where(free, least, np.inf)))
            step = least[following]
            u[owner[seen]] += step
            v[seen] -= step
            least[free] -= step
            column = following
        while column != n:
            owner[column] = owner[came[column]]
            column = came[column]
        owner[n] = -1
    out = np.empty(n, np.int64)
    out[owner[:n]] = np.arange(n)
    return out


def alike(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each source before (a row), which source after it is, by correlations over what both have."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return assignment(unit(before) @ unit(after).T)


def steps(blocks: DataFrame, by: list[str], sources: str) -> DataFrame:
    """by, block and order of all blocks: for each source of the block before, its place in this one; for the first block,
    and behind a missing one, places as they are. Only halves of blocks are shuffled."""
    half = F.floor(F.size(F.col(sources)[0]) / 2).cast("int")
    first = blocks.select(*by, "block", F.transform(sources, lambda x: F.slice(x, F.lit(1), half)).alias("after"))
    last = blocks.select(*by, (F.col("block") + 1).alias("block"), F.transform(sources, lambda x: F.slice(x, half + 1, half)).alias("before"))

    def resolve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            orders = [np.arange(len(y)) if x is None else alike(np.array(list(x), float), np.array(list(y), float)) for x, y in zip(part["before"], part["after"], strict=True)]
            yield part[[*by, "block"]].assign(order=orders)

    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in by)
    return first.join(last, [*by, "block"], "left").select(*by, "block", "before", "after").mapInPandas(resolve, f"{kinds}, block long, order array<long>")


def composed(orders: DataFrame, by: list[str], at: str = "block", order: str = "order", size: int = SLICE) -> DataFrame:
    """by, at and order: of each permutation, what all up to it compose to, where the first are applied first.

    Slices of `size` are composed each by one task; the slices' results are composed in the same way, as often as it takes
    to have one; and each slice goes on from where the one before it ended."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at)
        out, whole = [], None
        for own in part[order]:
            own = np.asarray(own)
            whole = own if whole is None else own[whole]
            out.append(whole)
        return part.assign(**{order: out})

    schema, slice_ = orders.select(*by, at, order).schema, f"{at}_"  # a name that no level before has
    number = F.floor(F.col(at) / size).alias(slice_)
    # Written, as it is read twice, at each level: else all that it comes from would be worked out twice as often each time.
    within = materialize(orders.select(*by, at, order).groupBy(*by, number).applyInPandas(lambda _, part: run(part), schema))
    last = within.agg(F.max(at)).first()[0]
    if last is None or last < size:
        return within
    ends = within.groupBy(*by, number).agg(F.max_by(order, at).alias(order))
    ahead = composed(ends, by, slice_, order, size).select(*by, (F.col(slice_) + 1).alias(slice_), F.col(order).alias("_ahead"))
    joined = within.select("*", number).join(ahead, [*by, slice_], "left")
    return joined.select(*by, at, F.when(F.col("_ahead").isNull(), F.col(order)).otherwise(F.transform("_ahead", lambda i: F.get(F.col(order), i.cast("int")))).alias(order))


def resolved(blocks: DataFrame, by: list[str], sources: str, size: int = SLICE) -> DataFrame:
    """blocks (by, block from 0 without gaps, sources: an array of signals for each source, of one length) with the sources
    of each recording in the order of its first block."""
    orders = composed(steps(blocks, by, sources), by, size=size).withColumnRenamed("order", "_order")
    ordered = F.transform("_order", lambda i: F.get(F.col(sources), i.cast("int")))
    return blocks.join(orders, [*by, "block"]).withColumn(sources, ordered).drop("_order")


def added_up(blocks: DataFrame, by: list[str], sources: str, window: list[float]) -> DataFrame:
    """by, source, chunk and samples of half a block each: windowed blocks added where they overlap. Chunk 0 is the first
    half of block 0."""
    half = len(window) // 2
    shaped = blocks.select(*by, "block", F.posexplode(sources).alias("source", "x")).withColumn("x", F.zip_with("x", F.lit(window), lambda a, w: a * w))
    parts = shaped.select(*by, "source", F.explode(F.array(F.struct(F.col("block").alias("chunk"), F.slice("x", 1, half).alias("x")), F.struct((F.col("block") + 1).alias("chunk"), F.slice("x", half + 1, half).alias("x")))).alias("p"))
    met = parts.groupBy(*by, "source", F.col("p.chunk").alias("chunk")).agg(F.collect_list("p.x").alias("_parts"))  # two at most
    samples = F.when(F.size("_parts") > 1, F.zip_with(F.col("_parts")[0], F.col("_parts")[1], lambda a, b: a + b)).otherwise(F.col("_parts")[0])
    return met.select(*by, "source", "chunk", samples.alias("samples"))
