"""Running numbers without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardpulse.session import pin

# Fixed by Spark: a monotonic id has the number within the part in its low bits.
PART_BITS = 33


def number_rows(frame: DataFrame, order_by: Sequence[str], into: str, start: Column) -> DataFrame:
    """Number the rows ``start + 1, start + 2, ...`` in the order of unique ``order_by``.

    Rows are range-partitioned and sorted inside each part, where the low bits of a
    monotonic id count them; a part's offset is the sum of the sizes before it, and only
    those sizes (one row per part) meet in one task. Rows are shuffled once. The placement
    is pinned first: a recomputed one could fall differently.
    """
    ordered = frame.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = pin(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", PART_BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << PART_BITS) - 1)) + 1
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(into, (start + F.col("_before") + inside).cast("long"))
        .drop("_part", "_place", "_before")
    )
