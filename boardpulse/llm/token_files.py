"""Token files: documents as Parquet list columns in id order, readable in part.

One row per document: its part, its place within the part, its number of ids and the ids
as a dictionary-encoded list column. Row groups and pages are small enough that a reader
who wants a range of documents, or only the metadata, skips the rest through the page
index. Rows are range-partitioned by id before they are encoded, so parts hold ascending
ranges; ties are ordered by a hash of the text, which also spreads a repeated id over
several parts. A document's place among all ids is the sum of the parts before it (one
number per part) plus its place within the part: no window over all documents.

Defined results: a null or empty text has only the end id; null ids come first; repeated
rows are written each, equal ids in order of the hash of their texts; an empty table gives
no rows; other columns are not written, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardpulse.llm.segments import encoder
from boardpulse.llm.shared import encode_frame, in_arrow, slices

SCHEMA = "part int, doc_id long, part_start long, n_tokens long, tokens array<int>"

# Dictionary pages hold any vocabulary below 256k; ids of a page range over few entries.
FORMAT = {
    "compression": "zstd",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.column.index.truncate.length": "32",
}


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every whole text, append ``end_id`` and write token files to ``folder``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1):
                ids, counts = ids_of.encode(batch.column(1).to_pylist())
                lengths = counts + 1
                ends = np.cumsum(lengths)
                flat = np.full(int(ends[-1]), end_id, np.int32)
                keep = np.ones(len(flat), bool)
                keep[ends - 1] = False
                flat[keep] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                yield encode_frame(
                    {
                        "part": pa.array(np.full(len(lengths), part), pa.int32()),
                        "doc_id": batch.column(0),
                        "part_start": pa.array(place + ends - lengths, pa.int64()),
                        "n_tokens": pa.array(lengths, pa.int64()),
                        "tokens": lists,
                    }
                )
                place += int(ends[-1])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    in_arrow(ordered, encode, SCHEMA).write.mode("errorifexists").options(**FORMAT).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of token files; select fewer columns to read fewer."""
    return spark.read.schema(SCHEMA).parquet(folder)


def part_starts(files: DataFrame) -> DataFrame:
    """Ids before each part: one row per part, read from the metadata columns alone."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))


def checksums(files: DataFrame) -> DataFrame:
    """Per document of token files: start among all ids, number of ids and CRC-32 of the ids as read."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            lengths = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield encode_frame(
                {name: batch.column(name) for name in ("part", "doc_id", "part_start")}
                | {"n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
            )

    read = in_arrow(
        files.select("part", "doc_id", "part_start", "n_tokens", "tokens"),
        check,
        "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long",
    )
    return read.join(part_starts(files), "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
