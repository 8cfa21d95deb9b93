"""Ping and access feeds, seed rows, and the check for required fields."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boardpulse.functions.text import is_blank
from boardpulse.sources import schemas


def read_ping_stream(
    spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = schemas.PINGS
) -> DataFrame:
    """Pings arriving as files. A message bus is read the same way under its own format."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def event_time(frame: DataFrame, column: str = "ts") -> DataFrame:
    """Turn a zone-less UTC column into an instant, as a watermark requires."""
    if not isinstance(frame.schema[column].dataType, T.TimestampNTZType):
        return frame
    in_session_zone = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column))
    return frame.withColumn(column, in_session_zone.cast("timestamp"))


def seed_rows(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """A hand-written row list as a table; for files use :func:`read_table`.

    Arrow columns become a local relation of known size. A plain row list would go
    through Python workers and hide its size from the planner.
    """
    listed = list(rows)
    columns = [
        pa.array([row[place] for row in listed], type=to_arrow_type(field.dataType))
        for place, field in enumerate(schema.fields)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def split_by_required(frame: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every required field, and the others with the fields they lack."""
    lacking = F.filter(
        F.array(*[F.when(_absent(frame, name), F.lit(name)) for name in required]),
        lambda name: name.isNotNull(),
    )
    checked = frame.withColumn("missing_fields", F.array_join(lacking, ","))
    accepted = checked.where(F.col("missing_fields") == "").drop("missing_fields")
    return accepted, checked.where(F.col("missing_fields") != "")


def _absent(frame: DataFrame, name: str):
    column = F.col(name)
    if isinstance(frame.schema[name].dataType, T.StringType):
        return is_blank(column)
    return column.isNull()


def accepted_pings(pings: DataFrame) -> DataFrame:
    """Pings that name a dashboard and belong to somebody, by a plain filter on the scan."""
    return pings.where(F.col("user_id").isNotNull() & ~is_blank(F.col("dashboard_url")))
