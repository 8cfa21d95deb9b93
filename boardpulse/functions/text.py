"""Text defaults, joined names and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = ", "
PREVIEW_LENGTH = 100


def is_blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def or_default(value: Column, default: str) -> Column:
    """``default`` in place of NULL and of empty text alike."""
    return F.when(is_blank(value), F.lit(default)).otherwise(value)


def blank_to_null(value: Column) -> Column:
    return F.when(~is_blank(value), value)


def joined_names(items: Column, keep_blank: bool = True) -> Column:
    """Names of an array of (id, name, ...) structs as one comma-separated text."""
    names = F.transform(items, lambda item: F.coalesce(item["name"], F.lit("")))
    if not keep_blank:
        names = F.filter(names, lambda name: name != "")
    return F.array_join(names, SEPARATOR)


def url_preview(url: Column) -> Column:
    return F.concat(F.substring(url, 1, PREVIEW_LENGTH), F.lit("..."))


def time_label(local_time: Column) -> Column:
    """Hour and day of a local time, dashes when there is none."""
    return F.coalesce(F.date_format(local_time, "HH:mm '|' dd/MM"), F.lit("---"))


def plain_number(value: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0+$", "")
