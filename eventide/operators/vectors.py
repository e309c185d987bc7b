"""Vectors as array columns: means, nearest neighbours among few, assignment to given centres, models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a table of labels or centres that every task may hold.
FEW, MATRIX_BYTES = 10_000, 64 << 20
#: Scores that a task holds at once.
SLICE_CELLS = 1 << 20


def mean_vectors(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by and the element-wise mean of the vectors of each group, which are of one length."""
    made = rows.where(F.col(vector).isNotNull()).select(*by, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return made.groupBy(*by).agg(Summarizer.mean(F.col("v")).alias("v")).select(*by, vector_to_array("v").alias(vector))


def nearest(rows: DataFrame, key: str, vector: str, others: DataFrame, label: str, other: str, measure: str = "cosine") -> DataFrame:
    """key, label and score of the most similar (cosine) or closest (l2, score is minus the squared distance) of a
    table of at most FEW vectors and MATRIX_BYTES; ties go to the least label, and the cosine of a zero vector is 0. The
    table goes to the tasks as one matrix, and a part of the rows meets it at a time."""
    sized = others.select(label, F.col(other).cast("array<double>").alias(other))
    n, width = sized.agg(F.count("*"), F.max(F.size(other))).first()
    if n > FEW or 8 * n * (width or 0) > MATRIX_BYTES:
        raise ValueError(f"more than {FEW} rows or {MATRIX_BYTES} bytes to compare every vector with")
    few = sized.orderBy(label).collect()
    labels = np.array([r[0] for r in few])
    matrix = np.array([r[1] for r in few], float)
    slice_rows = max(1, SLICE_CELLS // max(1, len(few)))

    def scores(v: np.ndarray) -> np.ndarray:
        if measure == "cosine":
            size = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)
            return np.divide(v @ matrix.T, size, out=np.zeros((len(v), len(matrix))), where=size > 0)
        return 2 * (v @ matrix.T) - (v * v).sum(1)[:, None] - (matrix * matrix).sum(1)

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), slice_rows):
                own = part.iloc[i : i + slice_rows]
                v = np.stack(own[vector].to_numpy()).astype(float)
                best = scores(v).argmax(1)
                score = scores(v)[np.arange(len(v)), best] if measure == "cosine" else -((v - matrix[best]) ** 2).sum(1)
                yield pd.DataFrame({key: own[key], label: labels[best], "score": score})

    kinds = T.StructType([rows.schema[key], others.schema[label], T.StructField("score", T.DoubleType())])
    return rows.select(key, vector).mapInPandas(compare, kinds)


def filled_matrix(keys: DataFrame, rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """The vectors of keys in rows; zeros for keys that have none."""
    zero = F.array_repeat(F.lit(0.0), size)
    return keys.join(rows.select(key, F.transform(vector, lambda x: x.cast("double")).alias(vector)), key, "left").withColumn(vector, F.coalesce(vector, zero))


def fit_filter(rows: DataFrame, vector: str, label: str, max_iter: int = 100, reg: float = 1e-4):
    """A logistic regression on vectors."""
    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, regParam=reg).fit(data)


def apply_filter(model, rows: DataFrame, vector: str) -> DataFrame:
    """rows with exclude: whether the model says 0."""
    found = model.transform(rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    return found.withColumn("exclude", F.col("prediction") == 0).select(*rows.columns, "exclude")


def fit_clusters(rows: DataFrame, vector: str, mean_size: int, seed: int = 1):
    """k-means with so many centres that clusters have mean_size rows in the mean."""
    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=max(2, data.count() // mean_size), seed=seed, maxIter=20).fit(data)
