"""Bounded training samples: the rows whose labels may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_ids(rows: DataFrame, id_column: str, most: int) -> DataFrame:
    """At most ``most`` distinct ids, those with the smallest hashes: one small row per kept id."""
    ids = rows.select(F.col(id_column).cast("long").alias("sample_id")).where("sample_id IS NOT NULL").distinct()
    return ids.orderBy(F.xxhash64("sample_id"), "sample_id").limit(most)


def texts_of(docs: DataFrame, ids: list[int], id_column: str, text_column: str) -> DataFrame:
    """Id and text of the documents with these ids; the list is bounded by the caller."""
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "sample_id long")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.join(F.broadcast(wanted), F.col("id") == F.col("sample_id")).select("id", "text")


def labelled_ids(labels: DataFrame, label: str, may_learn: Column, most: int, id_column: str = "doc_id") -> dict[int, list[int]]:
    """Up to ``most`` ids per class 0 and 1; ids with contradicting or null labels are left out."""
    usable = labels.where(may_learn & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("id"))
    agreed = usable.agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = high")
    out = {}
    for value in (0, 1):
        ids = sample_ids(agreed.where(F.col("low") == value), "id", most)
        out[value] = [row[0] for row in ids.collect()]
    return out
