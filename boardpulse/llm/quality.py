"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text becomes a vector of shares and rates, transformed so that a class is roughly
Gaussian. Per class the covariance is shrunk towards its diagonal and the pooled
covariance; the score is the logistic of the difference of the log-densities, computed
from Mahalanobis distances with the cached inverse Cholesky factors.

The labelled sample is bounded (``most`` per class); every row is scored over its whole
text in one pass without a shuffle.

Defined results: null and empty texts have the statistics of no words and are scored like
any other; without examples of both classes all scores are 0.5; repeated rows are scored
each; rows with a null id are scored; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardpulse.llm.labelled import labelled_ids, texts_of
from boardpulse.llm.shared import encode_frame, in_arrow

_SYMBOLS = [ord(c) for c in "#$%&*|@^~<>{}[]\\/=+_`"]
STATISTICS = 10


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text."""
    text = text or ""
    words = text.split()
    data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, size = len(words), max(1, int(data.sum()))
    upper, lower = int(data[65:91].sum()), int(data[97:123].sum())
    repeats = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = [line for line in text.split("\n") if line]
    # The added constants keep one repeat in a short text from weighing like many in a long one.
    shares = (
        upper / (upper + lower + 20),
        data[_SYMBOLS].sum() / (size + 20),
        (data[33] + data[63]) / (size + 20),
        (data[44] + data[46]) / (size + 20),
        data[48:58].sum() / (size + 20),
        repeats / (n + 20),
        max(0, n - 1 - pairs) / (n + 20),
        (len(lines) - len(set(lines))) / (len(lines) + 5),
    )
    distinct = np.log(len(set(words)) + 20) / np.log(n + 20)
    return [*np.sqrt(np.maximum(shares, 0)).tolist(), float(distinct), float(np.log1p(size / max(1, n)))]


@dataclass
class QualityModel:
    """Means, inverse Cholesky factors, log-determinants and log-priors of the classes 0 and 1."""

    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(vectors), 0.5)
        logs = []
        for k in (0, 1):
            z = (vectors - self.means[k]) @ self.factors[k].T
            logs.append(self.constants[k] - 0.5 * (z**2).sum(1))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -50, 50)))


def fit(vectors: np.ndarray, labels: np.ndarray, towards_pooled: float = 0.15, towards_diagonal: float = 0.1) -> QualityModel:
    """Shrunken class covariances; a floor on variances keeps constant statistics harmless."""
    if len(set(labels.tolist())) < 2:
        return QualityModel()
    groups = [vectors[labels == k] for k in (0, 1)]
    means = np.stack([g.mean(0) for g in groups])
    scatter = [np.cov(g - m, rowvar=False, bias=True).reshape(vectors.shape[1], -1) for g, m in zip(groups, means)]
    pooled = sum(s * len(g) for s, g in zip(scatter, groups)) / len(vectors)
    floor = np.diag(np.full(vectors.shape[1], 2.5e-3))
    factors, constants = [], []
    for g, s in zip(groups, scatter):
        weight = max(towards_pooled, len(s) / (len(s) + len(g)))
        s = (1 - weight) * s + weight * pooled
        s = (1 - towards_diagonal) * s + towards_diagonal * np.diag(np.diag(s)) + floor
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(len(g) / len(vectors)) - np.log(np.diag(lower)).sum())
    return QualityModel(means, np.stack(factors), np.array(constants))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    label: str = "quality",
    most: int = 10_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> QualityModel:
    """Fit on at most ``most`` labelled texts of each class; only their statistics reach the driver."""
    ids = labelled_ids(labels, label, may_learn, most, id_column)
    good = set(ids[1])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [statistics(text) for text in batch.column(1).to_pylist()]
            yield encode_frame({"id": batch.column(0), "vector": pa.array(vectors, pa.list_(pa.float64()))})

    sample = texts_of(docs, ids[0] + ids[1], id_column, text_column)
    rows = in_arrow(sample, describe, "id long, vector array<double>").orderBy("id", "vector").collect()
    if not rows:
        return QualityModel()
    return fit(np.array([row.vector for row in rows]), np.array([int(row.id in good) for row in rows]))


def score_quality(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` rows as id and score, one pass over the whole texts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [statistics(text) for text in batch.column(1).to_pylist()]
            yield encode_frame({"id": batch.column(0), "score": pa.array(model.scores(np.array(vectors).reshape(-1, STATISTICS)), pa.float64())})

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return in_arrow(rows, score, "id long, score double").withColumnRenamed("id", id_column)


def drop_poor(docs: DataFrame, model: QualityModel, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is at least ``threshold``, with all their columns."""
    place = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [statistics(text) for text in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(model.scores(np.array(vectors).reshape(-1, STATISTICS)) >= threshold))

    return in_arrow(docs, keep, docs.schema)
