"""Quality rules: counts of a text, and a calibrated logistic regression on hashed word and character n-grams.

The regression learns from a bounded sample of labelled rows; one fold of the sample calibrates its scores (Platt). Texts
are scored in Arrow batches: the n-grams of all texts of a chunk are hashed at once and their weights added up by text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import discard, materialize, order_hash, table
from eventide.llm.wordhash import Powers, chunks, mixed, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Labelled rows that the regression learns from, and those of every CALIBRATED that only calibrate it.
TRAIN_ROWS, CALIBRATED = 4000, 5
#: Partitions that the sample is fitted in.
FIT_PARTITIONS = 4
#: Buckets of each family of n-grams, and the families: words, pairs of words, and runs of so many characters.
BUCKETS = 1 << 14
RUNS = (3, 5)
FAMILIES = 2 + len(RUNS)
#: An odd multiplier, so that runs of code points keep apart in 64 bits.
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that are scored at once.
SCORED_BYTES = 1 << 18
#: A text's values of one family add up to this.
SCALE = 10.0
#: Least calibrated probability of good quality, and the limits of the counts.
MIN_PROBABILITY = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; null has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    own = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    runs = list(zip(own, own[1:], own[2:], strict=False))
    repeated = 0
    if len(set(runs)) < len(runs):
        often = Counter(runs)
        end = 0
        for i, run in enumerate(runs):
            if often[run] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return len(own), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def families(texts: list[bytes], powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams: buckets of all n-grams of the texts, and the number of those before each text."""
    hashes, bounds = words(texts, powers)
    yield (hashes % np.uint64(BUCKETS)).astype(np.int64), bounds
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:]) % np.uint64(BUCKETS)
    inside = np.ones(len(pairs), bool)
    ends = bounds[1:-1]
    inside[ends[(ends > 0) & (ends <= len(pairs))] - 1] = False  # pairs over the end of a text
    before = np.concatenate([[0], np.cumsum(inside)])
    yield pairs[inside].astype(np.int64), before[np.minimum(bounds, len(pairs))]
    decoded = [t.decode() for t in texts]
    data = np.frombuffer("".join(decoded).encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.cumsum([0, *map(len, decoded)])
    for n in RUNS:
        keys = np.zeros(max(0, len(data) - n + 1), np.uint64)
        for i in range(n):
            keys = keys * _STEP + data[i : i + len(keys)]
        inside = np.ones(len(keys), bool)
        for i in range(1, n):
            cut = starts[1:-1] - i
            inside[cut[(cut >= 0) & (cut < len(keys))]] = False
        before = np.concatenate([[0], np.cumsum(inside)])
        yield (mixed(keys[inside] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64), before[np.minimum(starts, len(keys))]


@dataclass
class Model:
    """Weights by family and bucket, the intercept, and the calibration: logit = slope * score + offset."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def scores(self, texts: list[bytes], powers: Powers) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        for w, (buckets, bounds) in zip(self.weights, families(texts, powers), strict=True):
            sums = np.concatenate([[0.0], np.cumsum(w[buckets])])
            n = np.diff(bounds)
            out += SCALE * np.divide(sums[bounds[1:]] - sums[bounds[:-1]], n, out=np.zeros(len(texts)), where=n > 0)
        return out

    def probabilities(self, texts: list[bytes], powers: Powers) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(texts, powers) + self.offset, -50, 50)))


def examples(sample: DataFrame, text: str, truth: str, fold: str) -> DataFrame:
    """label, fold and features (the sparse values of all n-grams) of every row of sample, made in one pass."""
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("fold", T.BooleanType()), T.StructField("features", VectorUDT())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first, texts in chunks(batch.column(2)):
                found = list(families(texts, powers))
                ix, val, ends = [], [], [0]
                for i in range(len(texts)):
                    for f, (buckets, bounds) in enumerate(found):
                        b, n = np.unique(buckets[bounds[i] : bounds[i + 1]], return_counts=True)
                        ix.append((b + f * BUCKETS).astype(np.int32))
                        val.append(SCALE * n / max(1, n.sum()))
                    ends.append(ends[-1] + sum(map(len, ix[-FAMILIES:])))
                ends, n = pa.array(ends, pa.int32()), len(texts)
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (ix, val)]
                sparse = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, FAMILIES * BUCKETS, np.int32)), *lists], names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), sparse], names=schema.fieldNames())

    return sample.select(truth, fold, text).mapInArrow(count, schema)


def train(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of label = 1, learned from the first `rows` labelled rows in a fixed pseudo-random order of key.

    labels has key and label; of labels that repeat a key the least counts, null ones count not; of texts that repeat a
    key the least is learned from. None if only one label, or none, is seen. The sample is written to the shared folder
    and fitted in FIT_PARTITIONS partitions, whatever the size of docs.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.min(label) == 1).cast("double").alias("_label"))
    order = order_hash(F.col(key).cast("string"))
    chosen = known.orderBy(order, key).limit(rows).select(F.col(key).alias("_key"), "_label", (F.pmod(order_hash(F.col(key).cast("string"), F.lit("fold")), F.lit(CALIBRATED)) == 0).alias("_fold"))
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").groupBy("_key", "_label", "_fold").agg(F.min("_text").alias("_text"))
    written = materialize(examples(found, "_text", "_label", "_fold"))
    model = fit(written.coalesce(FIT_PARTITIONS))
    discard(written)
    return model


def fit(made: DataFrame) -> Model | None:
    """A model of rows of label, fold and features: those outside the fold teach the weights, those in it calibrate."""
    seen = {(r["fold"], r["label"]): r["count"] for r in made.groupBy("fold", "label").count().collect()}
    if not (seen.get((False, 0.0)) and seen.get((False, 1.0))):
        return None
    fitted = LogisticRegression(maxIter=30, regParam=1e-4, standardization=False).fit(made.where(~F.col("fold")))
    model = Model(fitted.coefficients.toArray().reshape(FAMILIES, BUCKETS), float(fitted.intercept), 1.0, 0.0)
    if seen.get((True, 0.0)) and seen.get((True, 1.0)):
        score = array_to_vector(F.slice(vector_to_array("rawPrediction"), 2, 1))
        held = fitted.transform(made.where("fold")).select("label", score.alias("features"))
        platt = LogisticRegression(maxIter=60, regParam=1e-3, standardization=False).fit(held)
        model.slope, model.offset = float(platt.coefficients[0]), float(platt.intercept)
    return model


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, text: str, keys: list[str], model: Model | None, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """keys, the counts, base_failed, probability and kept of every row.

    A row is kept if its counts are within their limits and its probability of good quality reaches min_probability.
    Without a model the probability is null and the counts alone decide. A null text has no words, and fails. Equal
    rows each keep their row; other columns are not looked at.
    """
    schema = T.StructType([*(docs.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("probability", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            column = batch.column(len(keys))
            for first, texts in chunks(column, SCORED_BYTES):
                rows = [counts(t.decode()) for t in texts]
                p = pa.nulls(len(texts), pa.float64()) if model is None else pa.array(model.probabilities(texts, powers))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(texts)) for k in range(len(keys))), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), p], names=schema.fieldNames())

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = docs.select(*keys, text).mapInArrow(score, schema)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("probability") >= min_probability, F.lit(True)))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; the regression learns from the quality column of labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, "doc_id", "text", table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality")
    return judge(docs, "text", ["doc_id"], model)
