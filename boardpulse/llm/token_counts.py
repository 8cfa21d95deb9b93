"""Token counts: Arrow functions that encode byte-balanced batches and return lengths only.

Texts are cut at boundaries no token can cross (see ``segments``), so a long text is never
one call to the library. No shuffle: one pass over the texts.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each; an empty table gives an empty result; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.llm.segments import encoder
from boardpulse.llm.shared import encode_frame, in_arrow, slices


def token_counts(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: the id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(tokenizer, with_ids=False)
        for whole in batches:
            for batch in slices(whole, 1):
                n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
                counts = pa.array(lengths.count(batch.column(1).to_pylist()), pa.int64())
                yield encode_frame({"id": batch.column(0), "n_bytes": n_bytes, "n_tokens": counts})

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    counted = in_arrow(rows, count, "id long, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
