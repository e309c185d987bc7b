"""Mixing of sources to target weights by temperature.

A source's share of all tokens is raised to an exponent and the results are normalised. The exponent, between 0 (all
sources alike) and 1 (shares as they are), is found by bisection: the largest whose weights reach a target entropy and
repeat no source more than a limit allows, or nearest to that. Each source then gives its part of a token budget as
blocks: every block is a permutation of the source's documents, and the last one ends with the budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import table, whole_row

#: The exponent is a whole number of steps of 1 / STEPS.
STEPS = 4096
#: Sources up to which their plan is broadcast; it has a few numbers for each.
BROADCAST_SOURCES = 10_000
#: Documents of a source that one task puts in order.
ORDERED = 1000


@dataclass(frozen=True)
class Target:
    """What the weights must meet. entropy: at least this share of the entropy of equal weights; repeats: no source
    is read more often than this when the whole budget is spent. Either may be None."""

    entropy: float | None = None
    repeats: float | None = None


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised powers of the sources' shares; sources without tokens have weight 0."""
    total = sum(tokens.values())
    powers = {k: (v / total) ** exponent if v else 0.0 for k, v in tokens.items()}
    whole = math.fsum(powers.values())
    return {k: v / whole if whole else 0.0 for k, v in powers.items()}


def entropy_share(w: dict[str, float]) -> float:
    """Entropy of the weights as a share of the largest possible; 1 for a single source."""
    used = [x for x in w.values() if x > 0]
    return -math.fsum(x * math.log(x) for x in used) / math.log(len(used)) if len(used) > 1 else 1.0


def least_budget(tokens: dict[str, int], w: dict[str, float]) -> int:
    """The tokens at which every source is read in full at least once."""
    return max((math.ceil(v / w[k] - 1e-9) for k, v in tokens.items() if v), default=0)


def fits(tokens: dict[str, int], step: int, target: Target, budget: int | None) -> tuple[bool, bool]:
    """Whether an exponent of step / STEPS meets the entropy, and whether it meets the limit of repeats."""
    w = weights(tokens, step / STEPS)
    spent = least_budget(tokens, w) if budget is None else budget
    return target.entropy is None or entropy_share(w) >= target.entropy, target.repeats is None or all(w[k] * spent <= target.repeats * v + 1e-6 for k, v in tokens.items() if v)


def exponent(tokens: dict[str, int], target: Target, budget: int | None = None) -> float:
    """The exponent that meets target. Entropy falls as it grows and repetition too, so each has one border: bisection
    finds the largest step with enough entropy, and the least step with few enough repeats. The latter wins if both
    can't be met; 1 if the target asks for nothing."""

    def border(met) -> int:
        """The first step from 0 at which met is true; met is monotone. STEPS if it never is."""
        low, high = 0, STEPS
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if met(middle) else (middle + 1, high)
        return low

    if not any(tokens.values()):
        return 1.0
    step = STEPS
    if target.entropy is not None and not fits(tokens, STEPS, target, budget)[0]:
        step = max(0, border(lambda s: not fits(tokens, s, target, budget)[0]) - 1)
    elif target.repeats is not None and target.entropy is None:
        step = 0
    if target.repeats is not None:
        step = max(step, border(lambda s: fits(tokens, s, target, budget)[1]))
    return step / STEPS


def quotas(tokens: dict[str, int], w: dict[str, float], budget: int) -> dict[str, int]:
    """Tokens that each source gives: its weight of the budget, rounded to the nearest token."""
    return {k: math.floor(w[k] * budget + 0.5) for k in tokens}


def permuted(seed: int, block: Column, keys: list[str]) -> Column:
    """The place of a row in the permutation of a block: the first 60 bits of an MD5."""
    said = F.concat_ws(":", F.lit(str(seed)), block.cast("string"), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def drawn(docs: DataFrame, source: str, tokens: str, keys: list[str], target: Target, budget: int | None = None, seed: int = 0) -> DataFrame:
    """row (a whole row of docs), block, start and weight of every row that is drawn; see mix()."""
    count = F.greatest(F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    order = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(whole_row(docs).alias("row"), F.coalesce(F.col(f"`{source}`"), F.lit("\0null")).alias("source"), count.alias("tokens"), *(F.col(f"`{k}`").alias(o) for k, o in zip(keys, order, strict=True)))
    sizes = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    counted = {r["source"]: r["tokens"] for r in sizes}
    w = weights(counted, exponent(counted, target, budget))
    quota = quotas(counted, w, least_budget(counted, w) if budget is None else budget)
    plan = [(r["source"], float(w[r["source"]]), quota[r["source"]], counted[r["source"]], -(-r["n"] // ORDERED)) for r in sizes]
    plans = docs.sparkSession.createDataFrame(plan, "source string, weight double, quota long, size long, shares long")
    dealt = rows.join(F.broadcast(plans) if len(plan) <= BROADCAST_SOURCES else plans, "source")
    if budget is not None:
        dealt = dealt.where("quota > 0 and size > 0")
    last = F.when(F.col("size") > 0, F.greatest(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("size")))).otherwise(F.lit(0).cast("long"))
    blocks = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = blocks.withColumn("place", permuted(seed, F.col("block"), order)).withColumn("share", F.floor(F.col("place") / F.lit(1 << 60) * F.col("shares")))
    # A block's permutation is cut into shares of its range: each is ordered by one task, behind the sums before it.
    share = blocks.groupBy("source", "block", "share").agg(F.sum("tokens").alias("t"))
    before = share.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source", "block").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    own = Window.partitionBy("source", "block", "share").orderBy("place", *order, "tokens")
    placed = blocks.withColumn("own", F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).join(before, ["source", "block", "share"])
    placed = placed.withColumn("start", F.col("block") * F.col("size") + F.col("before") + F.col("own"))
    return placed.where("start < quota" if budget is not None else "block = 0 or start < quota").select("row", "block", "start", "weight")


def mix(docs: DataFrame, source: str, tokens: str, keys: list[str], target: Target, budget: int | None = None, seed: int = 0) -> DataFrame:
    """docs, each row as often as it is drawn, with block (from 0), start (tokens of its source before it) and weight;
    these replace columns of docs of the same names.

    A budget of None is the least with which every row is drawn at least once, rows of 0 tokens included. A source's
    quota takes whole blocks, then the rows of the last block up to the one that reaches the quota. Null sources are a
    source of their own; null or negative token counts are 0, and with a budget rows of 0 tokens are drawn where a block
    passes them. Equal rows are drawn each for itself; ties of the permutation go by keys. No rows, or a budget of 0, give
    no rows. One row for each source is brought to the driver.
    """
    out = drawn(docs, source, tokens, keys, target, budget, seed)
    kept = [c for c in docs.columns if c.lower() not in ("block", "start", "weight")]
    return out.select(*(F.col("row")[c].alias(c) for c in kept), "block", "start", "weight")


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")), F.lit(0)).cast("long")


#: The production target of the query and of the pipeline: a source is read twice at most, all documents at least once.
TARGET = Target(repeats=2.0)


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed so that small sources are read up to twice: doc_id, source, block, start, n_tokens, weight."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_tokens"))
    return mix(docs, "source", "n_tokens", ["doc_id"], TARGET).withColumn("weight", F.round("weight", 9))


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS s, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents
), z AS (
  SELECT s, sum(n_tokens)::BIGINT AS size FROM d GROUP BY s
), g AS (
  SELECT step, s, size, pow(size / sum(size) OVER (PARTITION BY step), step / {STEPS}) AS p FROM z, (SELECT unnest(range({STEPS} + 1)) AS step) WHERE size > 0
), w AS (
  SELECT step, s, size, p / sum(p) OVER (PARTITION BY step) AS weight FROM g
), b AS (
  SELECT *, max(ceil(size / weight - 1e-9)) OVER (PARTITION BY step) AS budget FROM w
), e AS (
  SELECT coalesce(min(step) FILTER (ok), {STEPS}) AS step FROM (SELECT step, bool_and(weight * budget <= {TARGET.repeats} * size + 1e-6) AS ok FROM b GROUP BY step)
), q AS (
  SELECT s, size, weight, floor(weight * budget + 0.5)::BIGINT AS quota FROM b WHERE step = (SELECT step FROM e)
), x AS (
  SELECT d.*, coalesce(size, 0) AS size, coalesce(weight, 0) AS weight, coalesce(quota, 0) AS quota, unnest(range(CASE WHEN size > 0 THEN greatest(0, (quota - 1) // size) ELSE 0 END + 1)) AS block FROM d LEFT JOIN q USING (s)
), o AS (
  SELECT *, block * size + sum(n_tokens) OVER (PARTITION BY s, block ORDER BY substr(md5('0:' || block || ':' || doc_id), 1, 15), doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM x
)
SELECT doc_id, source, n_tokens, block::BIGINT AS block, start::BIGINT AS start, round(weight, 9) AS weight FROM o WHERE block = 0 OR start < quota
"""
