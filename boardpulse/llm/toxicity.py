"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples carry a label; every other text is unlabelled. A linear
classifier over present word features minimises

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss: the share of toxic texts among the unlabelled ones (the class
prior) is subtracted from their risk as negatives, and a negative remainder, which only
over-fitting produces, is pushed back to zero (Kiryo et al. 2017).

Features are a word, its first four and its first five letters, present or absent in the
whole text; those clearly more frequent in toxic than in unlabelled texts are kept. The
samples for fitting are bounded (``most_positive``, ``most_unlabelled``), their features are
counted and chosen in Spark, and the driver gets places of chosen features only; every row is
scored over its whole text in one pass without a shuffle.

Defined results: null and empty texts have no features and score the bias alone; without
any toxic example all scores are 0; repeated rows are scored each; rows with a null id are
scored and held out as the empty text's checksum says; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardpulse.llm.labelled import labelled_ids, sample_ids, texts_of
from boardpulse.llm.shared import encode_frame, in_arrow, slices, stored

WORD = re.compile(r"[^\W_]+")
# Words remembered by one worker, at most.
MOST_WORDS = 600_000


def features_of(word: str) -> tuple[str, ...]:
    out = ["=" + word]
    if len(word) >= 4:
        out.append("4" + word[:4])
    if len(word) >= 5:
        out.append("5" + word[:5])
    return tuple(out)


def texts_features(text: str | None) -> set[str]:
    return {f for word in set(WORD.findall((text or "").lower())) for f in features_of(word)}


class _Groups(dict):
    """Word to the group of features it has, as the words of one task are met; group 0 has none."""

    def __init__(self, names: list[str]) -> None:
        super().__init__()
        self.places = {name: place for place, name in enumerate(names)}
        self.numbers: dict[tuple[int, ...], int] = {(): 0}
        self.members: list[tuple[int, ...]] = [()]

    def __missing__(self, word: str) -> int:
        had = tuple(self.places[f] for f in features_of(word) if f in self.places)
        if had not in self.numbers:
            self.numbers[had] = len(self.members)
            self.members.append(had)
        group = self[word] = self.numbers[had]
        return group


@dataclass
class ToxicModel:
    """Weight of each feature kept, and the bias; ``bias`` None scores everything 0."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float | None = None

    def scorer(self) -> Callable[[list[str | None]], np.ndarray]:
        """A function from texts to scores that remembers words from call to call."""
        groups, values = _Groups(list(self.weights)), np.array(list(self.weights.values()))

        def scores(texts: list[str | None]) -> np.ndarray:
            if self.bias is None:
                return np.zeros(len(texts))
            out = np.full(len(texts), self.bias)
            for place, text in enumerate(texts):
                met = set(map(groups.__getitem__, WORD.findall((text or "").lower())))
                met.discard(0)
                if met:
                    out[place] += values[sorted({f for group in met for f in groups.members[group]})].sum()
                if len(groups) > MOST_WORDS:
                    groups.clear()
            return 1 / (1 + np.exp(-np.clip(out, -50, 50)))

        return scores


def choose(positive: list[set[str]], unlabelled: list[set[str]], most: int) -> list[str]:
    """Features at least three times as frequent in toxic texts and beyond chance, strongest first."""
    p, u = _shares(positive), _shares(unlabelled)
    found = []
    for name, share in p.items():
        other = u.get(name, 0.0)
        pooled = (share * len(positive) + other * len(unlabelled)) / (len(positive) + len(unlabelled))
        error = np.sqrt(pooled * (1 - pooled) * (1 / len(positive) + 1 / len(unlabelled))) or 1.0
        z = (share - other) / error
        if z >= 4 and share >= 3 * other:
            found.append((-z, name))
    return [name for _, name in sorted(found)[:most]]


def _shares(texts: list[set[str]]) -> dict[str, float]:
    counts: dict[str, int] = {}
    for features in texts:
        for name in features:
            counts[name] = counts.get(name, 0) + 1
    return {name: count / len(texts) for name, count in counts.items()}


def fit(positive: list[set[str]], unlabelled: list[set[str]], prior: float, most: int = 1024, steps: int = 300) -> ToxicModel:
    """Fit to a few texts at hand, given as their features."""
    if not positive:
        return ToxicModel()
    unlabelled = unlabelled or [set()]
    names = choose(positive, unlabelled, most)
    places = {name: place for place, name in enumerate(names)}
    xp, xu = (_matrix([[places[f] for f in text if f in places] for text in texts], len(names)) for texts in (positive, unlabelled))
    return descend(names, xp, xu, prior, steps)


def _matrix(texts: list[list[int]], n_features: int) -> np.ndarray:
    """Present features of each text as ones, and a last column of ones for the bias."""
    out = np.zeros((len(texts), n_features + 1), np.float32)
    out[:, -1] = 1
    for row, places in enumerate(texts):
        out[row, places] = 1
    return out


def descend(names: list[str], xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 300) -> ToxicModel:
    """Minimise the non-negative risk estimator with full batches and Adam."""
    prior = min(max(prior, 1e-3), 0.5)
    w = np.zeros(len(names) + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-(xp @ w))), 1 / (1 + np.exp(-(xu @ w)))  # chance of toxic
        as_negative = -np.log1p(-np.clip(su, 0, 1 - 1e-6)).mean() + prior * np.log1p(-np.clip(sp, 0, 1 - 1e-6)).mean()
        grad_negative = xu.T @ su / len(su) - prior * (xp.T @ sp) / len(sp)
        grad_positive = -prior * (xp.T @ (1 - sp)) / len(sp)
        grad = grad_positive + grad_negative if as_negative >= 0 else -grad_negative
        grad = grad + 1e-4 * np.append(w[:-1], np.float32(0))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return ToxicModel(dict(zip(names, w[:-1].tolist())), float(w[-1]))


def strongest(described: DataFrame, n_positive: int, n_unlabelled: int, most: int) -> list[str]:
    """The rule of :func:`choose`, counted in Spark over rows of ``positive`` and ``features``."""
    p, u = F.col("p") / n_positive, F.col("u") / n_unlabelled
    pooled = (F.col("p") + F.col("u")) / (n_positive + n_unlabelled)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n_positive + 1 / n_unlabelled))
    counts = described.select("positive", F.explode("features").alias("name")).groupBy("name").agg(
        F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("u")
    )
    rated = counts.where("p > 0").select("name", p.alias("p"), u.alias("u"), ((p - u) / F.when(error > 0, error).otherwise(1.0)).alias("z"))
    best = rated.where((F.col("z") >= 4) & (F.col("p") >= 3 * F.col("u"))).orderBy(F.desc("z"), "name").limit(most)
    return [row["name"] for row in best.select("name").collect()]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    label: str = "toxic",
    most_positive: int = 2000,
    most_unlabelled: int = 4000,
    most_features: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> ToxicModel:
    """Fit on at most ``most_positive`` toxic and ``most_unlabelled`` other texts.

    The class prior is the share of toxic rows among the labels that may be learned from.
    """
    usable = labels.where(may_learn & F.col(label).isin(0, 1))
    share = usable.agg(F.avg(label)).first()[0] or 0.0
    positive = labelled_ids(labels, label, may_learn, most_positive, id_column)[1]
    known = set(positive)
    drawn = [row[0] for row in sample_ids(docs, id_column, most_unlabelled).collect()]
    unlabelled = [i for i in drawn if i not in known]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                features = [sorted(texts_features(text)) for text in batch.column(1).to_pylist()]
                yield encode_frame({"id": batch.column(0), "features": pa.array(features, pa.list_(pa.string()))})

    sample = texts_of(docs, sorted(known | set(unlabelled)), id_column, text_column)
    toxic = docs.sparkSession.createDataFrame([(i,) for i in positive], "toxic_id long")
    marked = in_arrow(sample, describe, "id long, features array<string>").join(F.broadcast(toxic), F.col("id") == F.col("toxic_id"), "left")
    described = stored(marked.select(F.col("toxic_id").isNotNull().alias("positive"), "features"), "toxic-sample")
    sizes = {row["positive"]: row["count"] for row in described.groupBy("positive").count().collect()}
    if not sizes.get(True):
        return ToxicModel()
    names = strongest(described, sizes[True], max(sizes.get(False, 0), 1), most_features)
    places = {name: place for place, name in enumerate(names)}

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[places[f] for f in features if f in places] for features in batch.column(1).to_pylist()]
            yield encode_frame({"positive": batch.column(0), "places": pa.array(kept, pa.list_(pa.int32()))})

    # A few thousand rows of places: what the driver gets does not depend on the length of texts.
    rows = in_arrow(described, locate, "positive boolean, places array<int>").toArrow()
    xs = [_matrix(rows.filter(pc.equal(rows["positive"], side))["places"].to_pylist(), len(names)) for side in (True, False)]
    return descend(names, xs[0], xs[1] if len(xs[1]) else _matrix([[]], len(names)), share)


def score_toxicity(docs: DataFrame, model: ToxicModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` rows as id and score, one pass over the whole texts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch in batches:
            yield encode_frame({"id": batch.column(0), "score": pa.array(scores(batch.column(1).to_pylist()), pa.float64())})

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return in_arrow(rows, score, "id long, score double").withColumnRenamed("id", id_column)


def drop_toxic(docs: DataFrame, model: ToxicModel, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    place = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(place).to_pylist()) < threshold))

    return in_arrow(docs, keep, docs.schema)
