"""The stages of the pipeline, each against what its operator decides on its own input."""

from __future__ import annotations

import corpus_pipeline
from boardpulse.llm import near_dup
from boardpulse.llm.decontaminate import find_leaks
from boardpulse.llm.shared import stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_operators_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, SF), f"test-{name}")
        assert after.columns == list(corpus_pipeline.COLUMNS)
        assert after.join(before, list(corpus_pipeline.COLUMNS), "left_anti").isEmpty()
        if name == "near_duplicates":
            kept = near_dup.near_duplicates(before).where("kept").select("doc_id")
            assert after.count() == kept.count() and after.join(kept, "doc_id", "left_anti").isEmpty()
        if name == "decontamination":
            benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert find_leaks(after, benchmark).isEmpty()
            assert before.count() - after.count() == find_leaks(before, benchmark).select("doc_id").distinct().count()
        before = after
    pieces = corpus_pipeline.run(spark, SF)
    assert sorted(r[0] for r in pieces.select("doc_id").distinct().collect()) == sorted(r[0] for r in before.select("doc_id").collect())
    whole = pieces.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()
    assert all(r["doc_tokens"] == r["sum(length)"] for r in whole)
