"""A corpus from raw documents to packed sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's result to the folder all executors share and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardpulse.llm.decontaminate import drop_leaks
from boardpulse.llm.near_dup import drop_near_duplicates
from boardpulse.llm.packing import pack
from boardpulse.llm.quality import drop_poor, fit_quality
from boardpulse.llm.shared import remainder, stored
from boardpulse.llm.toxicity import drop_toxic, fit_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the positive-unlabelled classifier does not reject."""
    docs = docs.select(*COLUMNS)
    model = fit_toxicity(docs, _labels(spark, sf_dir), may_learn=remainder("doc_id", 5) != 0)
    return drop_toxic(docs, model)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the discriminant does not reject."""
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, _labels(spark, sf_dir), may_learn=remainder("doc_id", 3) != 1)
    return drop_poor(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids' checksum in place of the ids."""
    return pack(docs.select(*COLUMNS)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# Classifiers and alignment cannot be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
