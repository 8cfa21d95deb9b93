"""Toxicity against a plain twin: features counted in Python, the risk in loops, whole texts scored."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boardpulse.llm import toxicity
from boardpulse.llm.labelled import sample_ids
from boardpulse.llm.queries import QUERIES
from boardpulse.llm.shared import remainder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    """The texts the operator learns from, told by the id rules alone."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    may_learn = remainder("doc_id", 5) != 0
    usable = labels.where(may_learn & F.col("toxic").isin(0, 1))
    known = {row["doc_id"] for row in usable.where("toxic = 1").collect()}
    drawn = {row[0] for row in sample_ids(docs, "doc_id", 4000).collect()} - known
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    prior = usable.agg(F.avg("toxic")).first()[0]
    model = toxicity.fit_toxicity(docs, labels, may_learn)
    return [toxicity.texts_features(texts[i]) for i in sorted(known)], [toxicity.texts_features(texts[i]) for i in sorted(drawn)], prior, model, texts


def test_features_chosen_in_spark_are_those_of_the_plain_rule(samples):
    positive, unlabelled, _, model, _ = samples
    assert set(model.weights) == set(toxicity.choose(positive, unlabelled, 1024)) and model.weights


def test_weights_equal_the_plain_fit(samples):
    positive, unlabelled, prior, model, _ = samples
    plain = toxicity.fit(positive, unlabelled, prior)
    assert model.bias == pytest.approx(plain.bias, abs=1e-3)
    assert all(model.weights[name] == pytest.approx(value, abs=1e-3) for name, value in plain.weights.items())


def risk(w, xp, xu, prior):
    """The non-negative estimator, text by text."""
    def loss(row, sign):
        return math.log1p(math.exp(-sign * float(row @ w)))

    plus = sum(loss(row, 1) for row in xp) / len(xp)
    minus = sum(loss(row, -1) for row in xu) / len(xu) - prior * sum(loss(row, -1) for row in xp) / len(xp)
    return prior * plus + max(0.0, minus), minus


def test_one_step_follows_the_numeric_gradient():
    numbers = np.random.default_rng(2)
    xp, xu = ((numbers.random((n, 5)) < 0.4).astype(np.float32) for n in (12, 20))
    xp[:, -1] = xu[:, -1] = 1
    prior = 0.2
    start = np.zeros(5)
    start[-1] = math.log(prior / (1 - prior))
    assert risk(start, xp, xu, prior)[1] > 0
    slope = [(risk(start + step, xp, xu, prior)[0] - risk(start - step, xp, xu, prior)[0]) / 2e-5 for step in np.eye(5) * 1e-5]
    model = toxicity.descend(list("abcd"), xp, xu, prior, steps=1)
    moved = np.array([*model.weights.values(), model.bias]) - start
    # Adam's first step has the same length in every direction, against the slope; the bias starts where its slope is 0.
    assert abs(slope[-1]) < 1e-6
    assert np.allclose(moved[:-1], -0.05 * np.sign(slope[:-1]), atol=1e-3)


def test_descent_lowers_the_risk():
    numbers = np.random.default_rng(3)
    xp, xu = ((numbers.random((n, 9)) < share).astype(np.float32) for n, share in ((40, 0.7), (90, 0.3)))
    xp[:, -1] = xu[:, -1] = 1
    risks = []
    for steps in (1, 20, 300):
        model = toxicity.descend(list("abcdefgh"), xp, xu, 0.2, steps)
        risks.append(risk(np.array([*model.weights.values(), model.bias]), xp, xu, 0.2)[0])
    assert risks[0] > risks[1] >= risks[2]


def test_registered_query_scores_whole_texts(spark, samples):
    *_, model, texts = samples
    for row in QUERIES["op6_toxicity"](spark, SF).collect():
        met = toxicity.texts_features(texts[row["doc_id"]])
        value = model.bias + sum(weight for name, weight in model.weights.items() if name in met)
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-value)), abs=1e-6)
        assert row["predicted"] == int(row["score"] >= 0.5)
