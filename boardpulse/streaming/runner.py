"""Drain a finite stream into a stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from boardpulse.session import run_dir
from boardpulse.streaming.rollup import read_partials, write_partials


def drain(frame: DataFrame, purpose: str) -> DataFrame:
    """Run an append-mode stream over everything available and read back its output."""
    folder = run_dir(frame.sparkSession, purpose)
    finish(frame.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out"), folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/out")


def drain_partials(pings: DataFrame, purpose: str, zone: str) -> DataFrame:
    """Store partial sessions of everything available and add them up."""
    spark, with_id = pings.sparkSession, "id" in pings.columns
    return drain_parts(
        spark, purpose, lambda path: write_partials(pings, path, zone), lambda path: read_partials(spark, path, with_id=with_id)
    )


def drain_parts(
    spark: SparkSession, purpose: str, write: Callable[[str], DataStreamWriter], read: Callable[[str], DataFrame]
) -> DataFrame:
    """Store parts of everything available and read their sum."""
    folder = run_dir(spark, purpose)
    finish(write(f"{folder}/out"), folder)
    return read(f"{folder}/out")


def finish(writer: DataStreamWriter, folder: str) -> None:
    """Start, process all available input, stop."""
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
