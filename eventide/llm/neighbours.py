"""Approximate nearest neighbours by inner product, by counting collisions of single-projection hashes.

Vectors of about one length make a band, and are brought to unit length with one more component, so that the largest
inner product with a query is the smallest distance to it. A block of a band has its vectors sorted along each of
PROJECTIONS lines at right angles. A query opens a window around its own place on every line; a vector collides once for
every window that holds it, and is verified if it collides on enough lines.

How wide the windows must be follows from the score to beat: it says how far away a vector can be at most, and so how
far apart along a line, and on how many lines, such a vector collides but for DEVIATIONS standard deviations. Windows start at
the distance that a sample of the block lets expect, and grow (virtual rehashing: no new hash tables) until they suit
the best k scores that were verified.

Queries first meet the bands of the longest vectors; of the others, only those whose longest vector could still beat
the k-th score found. What meets is dealt into blocks of vectors and blocks of queries.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import materialize, table

PROJECTIONS = 40
#: Half width of a window, in standard deviations of the distance along a line, and the share of lines on which a vector
#: at that distance collides by the normal distribution.
WIDTH, SHARE = 1.5, 0.8664
#: Standard deviations of the number of lines on which such a vector may collide less often than that.
DEVIATIONS = 1.5
#: Growth of windows that hold too few vectors, and vectors that the first width is guessed from.
GROWTH, SAMPLE = 1.25, 512
#: Bands of length: so many to a factor of two. The first pass takes bands of so many times k vectors.
BANDS, FIRST = 4, 4
#: Rows of a block of vectors and of a block of queries.
VECTOR_BLOCK, QUERY_BLOCK = 16384, 4096
SEED = 20


def lines(dimensions: int, projections: int = PROJECTIONS) -> np.ndarray:
    """Directions of the lines, as columns: orthonormal, so that no two lines tell the same; one for each dimension
    at most."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimensions, dimensions)))[0][:, :projections]


def first_guess(vectors: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """About the k-th best score of each query, from the mean and spread of its scores on evenly spaced vectors."""
    scores = queries @ vectors[:: max(1, len(vectors) // SAMPLE)].T
    tail = NormalDist().inv_cdf(max(0.5, 1 - k / len(vectors)))
    return scores.mean(1) + tail * scores.std(1)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, beat: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest found of a block of vectors for each query: query_id, vec_id, score. Scores under a query's `beat`
    (NaN: none) are of no interest."""
    n = len(ids)
    longest = np.sqrt(np.square(vectors).sum(1).max())
    lifted = np.hstack([vectors / longest, np.sqrt(np.maximum(0, 1 - np.square(vectors / longest).sum(1)))[:, None]])
    axes = lines(lifted.shape[1])
    at = np.ascontiguousarray((lifted @ axes).T)
    order = np.argsort(at, axis=1, kind="stable").astype(np.int32)
    at = np.take_along_axis(at, order, 1)
    length = np.linalg.norm(queries, axis=1)
    centre = (queries / length[:, None]) @ axes[:-1]
    m = len(at)
    apart = max(0, int(m * (1 - SHARE) + DEVIATIONS * np.sqrt(m * SHARE * (1 - SHARE))))  # lines on which a near one may not collide

    def distance(score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * score / (length * longest)))

    first = np.fmin(distance(np.where(np.isnan(beat), first_guess(vectors, queries, k), beat)), 2)
    half = WIDTH / np.sqrt(lifted.shape[1])

    def windows(q, radius) -> tuple[np.ndarray, np.ndarray]:
        """First place and end of the windows of queries q on every line."""
        c, r = centre[q], half * np.asarray(radius)
        return tuple(np.stack([np.searchsorted(at[j], c[..., j] + sign * r, side) for j in range(m)], -1) for sign, side in ((-1, "left"), (1, "right")))

    low, high = windows(slice(None), first)
    found_ids, found_scores, found_queries = [], [], []
    for q in range(len(queries)):
        radius, lo, hi = first[q], low[q].tolist(), high[q].tolist()
        while True:
            if radius < 2 and n > k:
                missed = np.bincount(np.concatenate([x for j in range(m) for x in (order[j, : lo[j]], order[j, hi[j] :])]), minlength=n)
                passed = np.flatnonzero(missed <= apart)
            else:  # no two unit vectors are further from each other
                radius, passed = 2, np.arange(n)
            passed = passed[ids[passed] != query_ids[q]]
            scores = vectors[passed] @ queries[q]
            wanted = 2.0
            if len(passed) >= k:
                wanted = np.sqrt(max(0, 2 - 2 * np.partition(scores, len(scores) - k)[len(scores) - k] / (length[q] * longest)))
            if not np.isnan(beat[q]):
                wanted = min(wanted, first[q])
            if wanted <= radius:
                break
            radius = min(wanted, radius * GROWTH + 0.05) if len(passed) < k else wanted
            lo, hi = (x.tolist() for x in windows(q, radius))
        best = np.lexsort((ids[passed], -scores))[:k]
        found_ids.append(ids[passed[best]])
        found_scores.append(scores[best])
        found_queries.append(np.full(len(best), query_ids[q]))
    joined = [np.concatenate(x) if x else np.zeros(0) for x in (found_queries, found_ids, found_scores)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), joined, strict=True)))


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (doubles) and length of the rows that take part: with a key, no null or non-finite component, not zero."""
    v = F.col("v")
    rows = embeddings.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def met(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the k nearest found of every query in every block of the bands that it goes to.

    vectors: dim, band, b (its block), id, v. queries: dim, band and nb (where it goes to, and that band's blocks), qb
    (its block), id, v, beat.
    """
    needed = queries.select("dim", "band", "qb").distinct()  # a row for each band and each QUERY_BLOCK queries
    left = vectors.join(F.broadcast(needed), ["dim", "band"]).select("dim", "band", "b", "qb", "id", "v", F.lit(False).alias("query"), F.lit(None).cast("double").alias("beat"))
    right = queries.select("dim", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"), "qb", "id", "v", F.lit(True).alias("query"), "beat")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("query", "ascending"), ("id", "ascending")])
        flat = group.column("v").combine_chunks()
        v = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        ids, query = group.column("id").to_numpy(), group.column("query").to_numpy()
        beat = group.column("beat").to_numpy()[query]
        found = search_block(ids[~query], v[~query], ids[query], v[query], beat, k) if query.any() and not query.all() else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pa.Table.from_pandas(found.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"}), preserve_index=False)

    return left.unionByName(right).groupBy("dim", "band", "b", "qb").applyInArrow(compare, "query_id long, vec_id long, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, key: str, vector: str, is_query, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of every query; is_query is a condition on "id".

    Every usable row but the query's own is a candidate; ties go to the smaller id. Rows whose vector is null, empty,
    zero, or has null or non-finite components take no part, and neither do rows without a key. Of vectors of several
    dimensions, those compare that have as many as the query. Fewer candidates than k are all returned; no queries, no
    rows. Repeated ids are rows of their own as candidates, but a query's id is searched for once in each dimension, by
    the least of its vectors.
    """
    rows = usable(embeddings, key, vector).withColumn("dim", F.size("v")).withColumn("band", F.round(BANDS * F.log2("length")).cast("int"))
    facts = rows.groupBy("dim", "band").agg(F.count("*").alias("n"), F.sum(F.when(is_query, 1).otherwise(0)).alias("q"), F.max("length").alias("longest"))
    own = Window.partitionBy("dim")
    longer = F.sum("n").over(own.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1))
    facts = facts.select("dim", "band", "longest", F.ceil(F.col("n") / VECTOR_BLOCK).alias("nb"), F.ceil(F.sum("q").over(own) / QUERY_BLOCK).alias("nq"), (F.coalesce(longer, F.lit(0)) < FIRST * k).alias("first")).where("nq > 0")
    facts = F.broadcast(materialize(facts))  # a row for each dimension and band
    vectors = rows.join(facts, ["dim", "band"]).select("dim", "band", F.pmod(F.xxhash64("id", "v"), F.col("nb")).alias("b"), "id", "v")
    queries = rows.where(is_query).groupBy("dim", "id").agg(F.min(F.struct("v", "length")).alias("x")).select("dim", "id", "x.*")
    queries = queries.join(facts, "dim").select("dim", "band", "nb", "first", "longest", F.pmod(F.xxhash64("id", F.lit(1)), F.col("nq")).alias("qb"), "id", "v", "length")
    found = best_of(met(vectors, queries.where("first").withColumn("beat", F.lit(None).cast("double")), k), k)
    if facts.where("not first").isEmpty():
        return found
    found = materialize(found)
    beat = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("beat"))
    open_ = queries.where("not first").join(beat, "id", "left").where(F.col("beat").isNull() | (F.col("length") * F.col("longest") * (1 + 1e-12) >= F.col("beat")))
    return best_of(found.drop("rank").unionByName(met(vectors, open_, k)), k)


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for every twentieth of them."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)
