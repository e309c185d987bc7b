"""Bipartite matching of reference and estimated events, and detection counts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.intervals import drop_shots, iou_pairs
from eventide.operators.scans import islands, sliced
from eventide.shared import discard, materialize


def augment(edges: list[tuple]) -> list[tuple]:
    """A largest matching of (reference, estimate) pairs by augmenting paths; references and then estimates are tried in
    order."""
    near: dict = {}
    for ref, est in sorted(edges):
        near.setdefault(ref, []).append(est)
    taken: dict = {}  # estimate -> reference
    own: dict = {}  # reference -> estimate
    for start in near:
        came: dict = {}  # estimate -> the reference that the search came from
        stack = [(start, iter(near[start]))]
        while stack:
            ref, others = stack[-1]
            est = next((e for e in others if e not in came), None)
            if est is None:
                stack.pop()
                continue
            came[est] = ref
            if est in taken:
                stack.append((taken[est], iter(near[taken[est]])))
                continue
            while est is not None:  # free: turn the path round
                ref = came[est]
                before = own.get(ref)
                taken[est], own[ref] = ref, est
                est = before
            break
    return sorted(own.items())


def match(pairs: DataFrame, by: str) -> DataFrame:
    """by, ref_id and est_id of a largest matching on pairs (l_ and r_ columns of an overlap join).

    Pairs whose ends have no other partner are in every largest matching, and need no search. The others fall into islands
    that share no moment, and so no event; each island is matched by itself, which keeps a long file from being one task's
    work. An island of contested pairs is one row: it holds the pairs of one stretch of a recording in which contested
    pairs follow each other without a break. The pairs are written once, and so is the result; the former are deleted.
    """
    partners = lambda event: F.count("*").over(Window.partitionBy(by, event))
    columns = [by, *(f"{side}_{c}" for side in "lr" for c in ("event_id", "begin_us", "end_us"))]
    sided = materialize(pairs.select(*columns).withColumn("_single", (partners("l_event_id") == 1) & (partners("r_event_id") == 1)))
    single = sided.where("_single").select(by, F.col("l_event_id").alias("ref_id"), F.col("r_event_id").alias("est_id"))
    hull = sided.where("not _single").select(by, F.least("l_begin_us", "r_begin_us").alias("b"), F.greatest("l_end_us", "r_end_us").alias("e"), F.struct("l_begin_us", "l_end_us", "l_event_id").alias("ref"), F.struct("r_begin_us", "r_end_us", "r_event_id").alias("est"))
    marked = islands(sliced(hull, [by], "b"), "b", "e")
    edges = marked.groupBy(by, "_island").agg(F.collect_list(F.struct("ref", "est")).alias("edges"))

    @F.pandas_udf("array<struct<ref_id:long,est_id:long>>")
    def matched(lists: pd.Series) -> pd.Series:
        out = []
        for island in lists:
            found = augment([(tuple(x["ref"].values()), tuple(x["est"].values())) for x in island])
            out.append([{"ref_id": r[2], "est_id": e[2]} for r, e in found])
        return pd.Series(out)

    out = materialize(edges.select(by, F.explode(matched("edges")).alias("m")).select(by, "m.ref_id", "m.est_id").unionByName(single))
    discard(sided)
    return out


def counts(reference: DataFrame, estimates: DataFrame, by: str, positive: Column, least: float, width: int, shots: int = 0) -> DataFrame:
    """tp, fp, fn and n_pos of every file of the reference.

    Positive events are matched first; estimates that are left are matched with the others, and those that match there
    count neither way. The first `shots` positives and all that ends by then are no targets; but in a file without
    estimates all positives are missed, those too.
    """
    targets = drop_shots(reference, [by], "begin_us", "end_us", positive, shots) if shots else reference
    columns = [by, "event_id", "begin_us", "end_us"]
    first = match(iou_pairs(targets.where(positive).select(*columns), estimates, by, least, width), by)
    left = estimates.join(first.select(by, F.col("est_id").alias("event_id")), [by, "event_id"], "left_anti")
    second = match(iou_pairs(targets.where(~positive).select(*columns), left, by, least, width), by)

    def ones(rows: DataFrame, **own: Column) -> DataFrame:
        return rows.select(by, *(own.get(c, F.lit(0)).cast("long").alias(c) for c in ("_file", "_all", "_targets", "_n", "tp", "_other")))

    # All numbers of a file are sums of ones over rows of five kinds: one aggregate.
    kinds = [ones(reference, _file=F.lit(1), _all=F.when(positive, 1).otherwise(0)), ones(targets.where(positive), _targets=F.lit(1)), ones(estimates, _n=F.lit(1)), ones(first, tp=F.lit(1)), ones(second, _other=F.lit(1))]
    rows = reduce(DataFrame.unionByName, kinds)
    files = rows.groupBy(by).agg(*(F.sum(c).alias(c) for c in rows.columns if c != by)).where("_file > 0")
    n_pos = F.when(F.col("_n") == 0, F.col("_all")).otherwise(F.col("_targets"))
    return files.select(by, "tp", (F.col("_n") - F.col("tp") - F.col("_other")).alias("fp"), (n_pos - F.col("tp")).alias("fn"), n_pos.alias("n_pos"))
