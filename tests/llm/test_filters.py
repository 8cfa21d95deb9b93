"""Toxicity, quality, URL filter and decontamination on small fixtures and held-out rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardpulse.llm import decontaminate, quality, toxicity, url_model
from boardpulse.llm.queries import QUERIES, URL_RULES

EDGE = [(1, None), (2, ""), (3, "word " * 50_000), (None, "no id"), (4, "twin"), (4, "twin")]


def held_out(spark, sf_dir, name, label):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label)
    found = QUERIES[name](spark, sf_dir)
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return found.where("held_out").join(labels, "doc_id").select(F.col(label).alias("truth"), "predicted", "score").toPandas()


def test_quality_on_held_out_rows(spark):
    rows = held_out(spark, "/root/testdata/sf0.01", "op7_quality", "quality")
    assert (rows.truth == rows.predicted).mean() >= 0.95


def test_toxicity_on_held_out_rows(spark):
    rows = held_out(spark, "/root/testdata/sf0.01", "op6_toxicity", "toxic")
    assert (rows.truth == rows.predicted).mean() >= 0.9 and rows[rows.truth == 0].predicted.mean() <= 0.05


def test_positive_unlabelled_risk_finds_hidden_positives():
    toxic, clean = [{"=bad", f"={k}"} for k in range(40)], [{f"={k}"} for k in range(40)]
    model = toxicity.fit(toxic, [*clean, *clean, *clean, *toxic[:20]], prior=0.15)
    assert set(model.weights) == {"=bad"}
    assert model.scorer()(["a bad day", "a day", None]).round().tolist() == [1, 0, 0]


def test_models_without_examples(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    docs = make_docs(EDGE, extra=True)
    model = toxicity.fit_toxicity(docs, none, F.lit(True))
    assert {r["score"] for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    other = quality.fit_quality(docs, none, F.lit(True))
    assert {r["score"] for r in quality.score_quality(docs, other).collect()} == {0.5}
    assert toxicity.score_toxicity(make_docs([]), model).count() == quality.score_quality(make_docs([]), other).count() == 0


def test_scores_of_odd_texts_are_defined(spark, make_docs):
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 0), (4, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    docs = make_docs(EDGE, extra=True)
    for scored in (
        toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, F.lit(True))),
        quality.score_quality(docs, quality.fit_quality(docs, labels, F.lit(True))),
    ):
        rows = scored.collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)


def test_discriminant_equals_the_gaussian_densities():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (80, 10)), rng.normal(1, 2, (120, 10))])
    y = np.repeat([0, 1], [80, 120])
    model = quality.fit(x, y)
    logs = []
    for k in (0, 1):
        lower = np.linalg.inv(model.factors[k])
        cov, gap = lower @ lower.T, x - model.means[k]
        logs.append(math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -50, 50))))


URLS = {
    "https://A.B.Example.ORG/es/1?x#y": ("a.b.example.org", "/es/1", "example.org/es/", "block"),
    "http://org/en/1": ("org", "/en/1", "org/", "allow"),
    "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
    "http://x.com/fr/1#top": ("x.com", "/fr/1", "com/fr/", "allow"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://net": ("net", "", None, None),
    "no scheme": ("", "", None, None),
    "x://h?q/://": ("h", "", None, None),
    None: ("", "", None, None),
}


def test_urls(spark):
    rows = [(k, u, "html", "x") for k, u in enumerate(URLS)] + [(None, "http://net", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, score string")
    found = {r["page_id"]: r for r in url_model.judge_urls(pages, URL_RULES, url_model.training_table(spark)).collect()}
    assert len(found) == len(URLS) + 1
    for k, (host, path, rule, verdict) in enumerate(URLS.values()):
        row = found[k]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or ("block" if row["score"] >= 0.5 else "allow"))


def test_url_model_equals_gradient_descent_on_weights(spark):
    training = url_model.training_table(spark)
    host, path = url_model.host_and_path(F.col("url"))
    rows = training.select("label", url_model.buckets_of(host, path).alias("grams")).collect()
    x = np.zeros((len(rows), url_model.BUCKETS + 1))
    for k, row in enumerate(rows):
        for bucket in row["grams"]:
            x[k, bucket] += 1 / math.sqrt(len(row["grams"]))
        x[k, -1] = 1
    y, w = np.array([r["label"] for r in rows], float), np.zeros(url_model.BUCKETS + 1)
    for _ in range(100):
        w = w * (1 - 0.5 * 0.001) + 0.5 * x.T @ (y - 1 / (1 + np.exp(-(x @ w))))
    model = url_model.fit_urls(training).first()
    assert np.allclose(model["weights"], w[:-1]) and np.isclose(model["bias"], w[-1])
    assert url_model.judge_urls(spark.createDataFrame([], "page_id long, url string"), [], training).count() == 0


ITEM = "Alice Smith has 12 apples and gives 5 apples to Bob before Alice Smith walks 3 miles home."
LEAKS = [
    (1, "Intro text. Zoe Brown has 40 apples and gives 9 apples to Tom before Zoe Brown walks 8 kg home. More."),
    (2, "Zoe has 40 apples and then nothing of the kind happens to anybody at all in this text."),
    (3, None), (4, ""), (5, "word " * 30_000), (6, ITEM), (6, ITEM), (None, ITEM),
]


def test_templates_catch_changed_numbers_names_and_units(spark, make_docs):
    benchmark = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "1 2 3 4 5 6 7 8 9"), (None, ITEM)], "item_id long, text string")
    docs = make_docs(LEAKS, extra=True)
    found = decontaminate.find_leaks(docs, benchmark).collect()
    assert sorted(((r["doc_id"] or 0), r["item_id"]) for r in found) == [(0, 7), (1, 7), (6, 7), (6, 7)]
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    none = benchmark.limit(0)
    assert decontaminate.find_leaks(docs, none).count() == 0 and decontaminate.drop_leaks(docs, none).count() == len(LEAKS)
    assert decontaminate.find_leaks(make_docs([]), benchmark).count() == 0


def test_short_first_word_and_long_run_leaks(spark, make_docs):
    long_item = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)).replace("word", "w")
    items = [(1, "What is 37 plus 48?"), (2, "Compute 12 * 7 + 5 - 3."), (3, "Which planet is closest to the sun"), (4, long_item), (5, "Why not?")]
    docs = make_docs(
        [
            (1, "He asked: what is 37 plus 48? Nobody knew."), (2, "Compute 12 * 7 + 5 - 3."), (3, "Question: Which planet is closest to the sun"),
            (4, "Before it " + " ".join(long_item.split()[20:35]) + " and after"), (5, "Really. Why not? Because."), (6, "why not go there"),
            (7, "What is 38 plus 48?"), (8, "Before it " + " ".join(long_item.split()[20:31]) + " and after"),
        ]
    )
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()) == [(k, k) for k in range(1, 6)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, benchmark).collect()) == [6, 7, 8]


def test_slots_have_to_be_consistent():
    match = decontaminate.TemplateIndex.build([(1, ITEM)]).matcher()
    mixed = "Zoe has 40 apples and gives 40 apples to Zoe before Max walks 8 miles home."
    assert match(ITEM)[0][1] == match(ITEM)[0][2] and all(found < total for _, found, total in match(mixed))


def test_blocks_of_items_give_the_same_leaks(spark, make_docs):
    benchmark = spark.createDataFrame([(k, ITEM.replace("apples", f"fruits{k}")) for k in range(6)], "item_id long, text string")
    indexes = list(decontaminate.blocks(benchmark, most=60))
    assert len(indexes) > 1 and sorted(i for x in indexes for i in x.item_ids) == list(range(6))


def test_template_windows_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    words = decontaminate._Words()
    plain = lambda t: decontaminate.template(t, words)[0].tolist()
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = plain(r["text"])
        have = {tuple(text[k : k + 8]) for k in range(len(text) - 7)}
        for item, codes in items:
            windows = [tuple(codes[k : k + 8]) for k in range(len(codes) - 7)]
            if windows and sum(w in have for w in windows) >= 0.5 * len(windows):
                expected.add((r["doc_id"], item))
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontamination"](spark, sf).collect()} == expected
