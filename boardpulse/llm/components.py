"""Connected components of a table of links, iterated over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """Node and label (the smallest node of its component) for every node of ``links`` (a, b).

    Every round gives each node the smallest label around it, then follows labels to the
    labels of labels, so that chains shorten by halves; a star needs two rounds. Minima
    are combined before each shuffle, so a node with very many links is no hot key, and
    the joins split skewed keys. Each round is written to the shared folder. Null ends and
    links of a node to itself name the node alone; repeated links change nothing.
    """
    real = links.where("a IS NOT NULL AND b IS NOT NULL")
    both = stored(real.select("a", "b").unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        # The smallest label among the neighbours.
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "seen"}), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        lower = stored(lower, "labels")
        # The label of the label.
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        moved = stored(
            lower.join(jump, "label").select("node", F.col("root").alias("label"), (F.col("root") != F.col("old")).alias("changed")),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return labels
