"""Where results go: row sets and the report document."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_rows(frame: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A result set in any built-in format; JSON keeps columns that are NULL."""
    writer = frame.write.mode("overwrite").format(fmt)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.save(path)


def write_document(document: DataFrame, path: str) -> None:
    """The one-row report document as a JSON text file."""
    document.write.mode("overwrite").text(path)
