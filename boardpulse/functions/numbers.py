"""Ratios rounded half away from zero, safe against empty denominators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(20,0)"


def ratio(top: Column, bottom: Column, places: int = 1, scale: int = 1) -> Column:
    """``top / bottom * scale`` rounded; NULL when ``bottom`` is zero."""
    share = top.cast(EXACT) / F.nullif(bottom.cast(EXACT), F.lit(0).cast(EXACT))
    return F.round(share * F.lit(scale), places)


def variation(current: Column, previous: Column) -> Column:
    """Change in whole percent against ``previous``; zero when there was nothing before."""
    change = F.round((current - previous).cast(EXACT) / previous.cast(EXACT) * F.lit(100), 0)
    return F.when(previous > 0, change.cast("long")).otherwise(F.lit(0).cast("long"))


def share_percent(part: Column, whole: Column) -> Column:
    """Part of the whole in percent; an empty whole counts as one."""
    safe = F.when(whole.isNull() | (whole == 0), F.lit(1)).otherwise(whole)
    return part.cast("double") / safe.cast("double") * F.lit(100.0)
