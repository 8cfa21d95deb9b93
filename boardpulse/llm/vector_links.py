"""Near-duplicate vectors by NN-descent: a neighbour graph refined until its links are complete.

1. Equal vectors become one node with a number of copies; null, zero and non-finite
   vectors are no nodes.
2. Start: along several random projections the nodes are range-partitioned and sorted by
   sign bits and projection, and each gets its best ``k`` within blocks of the order.
3. Refinement: a node's neighbours, in both directions, are compared with each other
   (neighbours of neighbours of one another); what beats a list's worst entry enters it.
   Rounds stop when hardly any list changes.
4. Links at the threshold give components. A list that holds nothing but links is
   saturated and may hide more of them: where a component is larger than a list, its
   members are compared in blocks spread over the cluster, so that lists there grow as
   far as the component reaches and the number of links is complete. Before that the
   saturated nodes of different components are compared, because their links across may be
   in no list: in cells of one component each, left out only where the cells' centres are
   too far apart for their radiuses. A list that is not saturated has no room to hide links.
5. Audit: nodes are drawn by hash and their links counted against all nodes by brute force,
   until ``ENOUGH`` nodes with few links and ``ENOUGH`` with more than a list were seen, or all
   nodes. While any of them has less than ``recall`` of its links, new projections are added.
6. Tables below ``recall`` after ``tries`` are checked exactly, every block with every block;
   such work grows with the square of the table. The size of the table decides nothing; a
   caller may ask for the exact check alone up to ``exact_to`` nodes.

Cosines are in double precision. Defined results: a vector that cannot be compared links
with nothing and is its own component, as are vectors whose length no other has; repeated
rows are copies of one another; rows with a null id count as copies and come back with a
null id; an empty table gives no rows; labels and other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardpulse.llm.components import components
from boardpulse.llm.shared import encode_frame, in_arrow, stored, whole_groups

BLOCK = 256
GROUP = 32
CELL = 1024
ENOUGH = 200
DRAWN = 4096
LISTS = "node long, nbr long, sim double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    lengths = np.diff(batch.column(column).offsets.to_numpy())
    for length in np.unique(lengths):
        yield batch if (lengths == length).all() else batch.filter(pa.array(lengths == length))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best ``k`` per row of a square matrix, itself excluded."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(sims) - 1)
    if k <= 0:
        return np.zeros(0, int), np.zeros(0, int)
    columns = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(sims)), k), columns.ravel()


def _lists(nodes: np.ndarray, sims: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> pa.RecordBatch:
    return encode_frame({"node": pa.array(nodes[rows]), "nbr": pa.array(nodes[columns]), "sim": pa.array(sims[rows, columns])})


def _along_projection(nodes: DataFrame, seed: int, k: int, bits: int = 8) -> DataFrame:
    """Best neighbours within blocks of the order along random directions."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 1):
                unit = _matrix(batch.column(1))
                ways = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], bits + 1))
                seen = unit @ ways
                sign = (seen[:, :bits] > 0) @ (1 << np.arange(bits)) + unit.shape[1] * (1 << bits)
                yield encode_frame({"leaf": pa.array(sign, pa.int64()), "way": pa.array(seen[:, -1]), "node": batch.column(0), "vector": batch.column(1)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                for batch in _by_length(whole.slice(begin, BLOCK), 1):
                    unit = _matrix(batch.column(1))
                    sims = unit @ unit.T
                    yield _lists(batch.column(0).to_numpy(), sims, *_best(sims, k))

    projected = in_arrow(nodes.select("node", "vector"), project, "leaf long, way double, node long, vector array<double>")
    ordered = projected.repartitionByRange("leaf", "way", "node").sortWithinPartitions("leaf", "way", "node")
    return in_arrow(ordered.select("node", "vector"), compare, LISTS)


def _keep_best(lists: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    return lists.dropDuplicates(["node", "nbr"]).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank")


def _refined(nodes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Pairs of neighbours of a common node that beat the worst entry of a list."""
    ways = lists.select("node", "nbr").unionByName(lists.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()
    drawn = Window.partitionBy("node").orderBy(F.xxhash64("node", "nbr"))
    ways = ways.withColumn("rank", F.row_number().over(drawn)).where(F.col("rank") <= 2 * k).drop("rank")
    worst = lists.groupBy("node").agg(F.when(F.count("sim") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    known = nodes.join(worst, "node", "left").select(F.col("node").alias("nbr"), "vector", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    groups = ways.join(known, "nbr").repartition("node").sortWithinPartitions("node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 2):
                unit, centres = _matrix(batch.column(2)), batch.column(0).to_numpy()
                names, worst = batch.column(1).to_numpy(), batch.column(3).to_numpy()
                cuts = np.flatnonzero(np.diff(centres)) + 1
                us, vs, found = [], [], []
                for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(centres)]):
                    sims = unit[begin:end] @ unit[begin:end].T
                    np.fill_diagonal(sims, -3)
                    rows, columns = np.nonzero(sims > worst[begin:end, None])
                    us.append(names[begin + rows])
                    vs.append(names[begin + columns])
                    found.append(sims[rows, columns])
                yield encode_frame({"node": pa.array(np.concatenate(us)), "nbr": pa.array(np.concatenate(vs)), "sim": pa.array(np.concatenate(found))})

    return in_arrow(groups.select("node", "nbr", "vector", "worst"), compare, LISTS).dropDuplicates(["node", "nbr"])


def _cells(saturated: DataFrame) -> DataFrame:
    """Centre and radius (an angle) of every cell of saturated nodes (label, piece, node, vector)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 2):
            unit = _matrix(batch.column(2))
            centre = unit.mean(0)
            norm = np.linalg.norm(centre)
            centre = centre / norm if norm > 1e-9 else unit[0]
            radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
            label, piece = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            yield encode_frame(
                {
                    "label": pa.array([label], pa.int64()),
                    "piece": pa.array([piece], pa.int64()),
                    "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
                    "radius": pa.array([radius]),
                }
            )

    rows = saturated.select("label", "piece", "vector").repartition("label", "piece").sortWithinPartitions("label", "piece")
    return in_arrow(rows, measure, "label long, piece long, centre array<double>, radius double")


def _near_cells(cells: DataFrame, threshold: float) -> DataFrame:
    """Pairs of cells of different components that can hold a link across."""
    n_blocks = -(-cells.count() // CELL) or 1
    reach = float(np.arccos(threshold)) + 1e-6
    placed = cells.withColumn("block", F.pmod(F.xxhash64("label", "piece"), F.lit(n_blocks)).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    rows = pairs.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "label", "piece", "radius", "centre")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, 2):
            for batch in _by_length(whole, 6):
                block, label, piece, radius = (batch.column(k).to_numpy() for k in (2, 3, 4, 5))
                unit = _matrix(batch.column(6))
                near = np.arccos(np.clip(unit @ unit.T, -1, 1)) <= radius[:, None] + radius[None, :] + reach
                near &= label[:, None] < label[None, :]
                if whole.column(0)[0] != whole.column(1)[0]:
                    near &= block[:, None] != block[None, :]
                x, y = np.nonzero(near)
                yield encode_frame({"a": pa.array(label[x]), "a_piece": pa.array(piece[x]), "b": pa.array(label[y]), "b_piece": pa.array(piece[y])})

    return in_arrow(rows.repartition("low", "high").sortWithinPartitions("low", "high"), compare, "a long, a_piece long, b long, b_piece long")


def _bridges(nodes: DataFrame, lists: DataFrame, labels: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs of components (a, b) with a link between two of their saturated nodes."""
    full = lists.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("worst")).where((F.col("n") >= k) & (F.col("worst") >= threshold))
    full = stored(full.select("node").join(labels, "node"), "saturated")
    sizes = full.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("pieces"))
    placed = full.join(sizes, "label").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")))
    saturated = stored(placed.join(nodes, "node").select("label", "piece", "vector"), "saturated")
    cells = stored(_cells(saturated), "cells")
    near = stored(_near_cells(cells, threshold).withColumn("pair", F.monotonically_increasing_id()), "near")
    sides = near.select("pair", F.lit(0).alias("side"), F.col("a").alias("label"), F.col("a_piece").alias("piece"))
    sides = sides.unionByName(near.select("pair", F.lit(1).alias("side"), F.col("b").alias("label"), F.col("b_piece").alias("piece")))
    rows = sides.join(saturated, ["label", "piece"]).select("pair", "side", "label", "vector").repartition("pair").sortWithinPartitions("pair", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 1):
            unit, second = _matrix(batch.column(3)), batch.column(1).to_numpy() == 1
            if (unit[~second] @ unit[second].T >= threshold).any():
                names = batch.column(2).to_numpy()
                yield encode_frame({"a": pa.array(names[:1]), "b": pa.array(names[-1:])})

    return in_arrow(rows, compare, "a long, b long")


def _component_links(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Links of every node within its component, by comparing blocks of members."""
    sizes = stored(labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "sizes")
    members = stored(labels.join(sizes, "label"), "members").join(nodes, "node")
    # The members of a component fall into blocks; every pair of blocks is one comparison.
    n_blocks = F.ceil(F.col("size") / GROUP).cast("int")
    placed = members.withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int")).withColumn("blocks", n_blocks)
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    pairs = pairs.withColumn("low", low).withColumn("high", high).withColumn("first", F.col("block") == F.col("low"))
    grouped = pairs.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 3):
            for part in _by_length(batch, 5):
                unit, names, copies = _matrix(part.column(5)), part.column(3).to_numpy(), part.column(6).to_numpy()
                first = part.column(4).to_numpy(zero_copy_only=False).astype(bool)
                linked = unit @ unit.T >= threshold
                np.fill_diagonal(linked, False)
                if not first.all():  # two blocks: only pairs across
                    linked &= first[:, None] != first[None, :]
                yield encode_frame({"node": pa.array(names), "n": pa.array((linked * copies[None, :]).sum(1), pa.int64())})

    rows = grouped.select("label", "low", "high", "node", "first", "vector", "copies")
    return in_arrow(rows, compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _exact(nodes: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Labels (node, label) and numbers of links (node, n), every node compared with every other."""
    n_blocks = -(-n // min(8192, max(512, -(-n // 6)))) or 1
    placed = nodes.select(F.pmod(F.xxhash64("node"), F.lit(n_blocks)).cast("int").alias("block"), "node", "copies", "vector")
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    rows = pairs.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, 2):
            for batch in _by_length(whole, 5):
                unit, (block, names, copies) = _matrix(batch.column(5)), (batch.column(k).to_numpy() for k in (2, 3, 4))
                across = whole.column(0)[0] != whole.column(1)[0]
                totals, low = np.zeros(len(unit), np.int64), names.copy()
                heads, tails = [], []
                for begin in range(0, len(unit), 256):
                    linked = unit[begin : begin + 256] @ unit.T >= threshold
                    if across:  # two blocks: only pairs across
                        linked &= block[begin : begin + 256, None] != block[None, :]
                    x, y = np.nonzero(linked)
                    x += begin
                    x, y = x[x != y], y[x != y]
                    totals += np.bincount(x, copies[y], len(unit)).astype(np.int64)
                    # One step towards a smaller node, so that a row leaves few pairs behind.
                    np.minimum.at(low, x, low[y])
                    other = low[x] != low[y]
                    ends = np.unique(np.stack([low[x[other]], low[y[other]]], 1), axis=0)
                    heads.append(ends[:, 0])
                    tails.append(ends[:, 1])
                moved = low != names
                yield encode_frame(
                    {
                        "a": pa.array(np.concatenate([names, names[moved], *heads])),
                        "b": pa.array(np.concatenate([names, low[moved], *tails])),
                        "n": pa.array(np.concatenate([totals, np.zeros(moved.sum() + sum(map(len, heads)), np.int64)])),
                    }
                )

    grouped = rows.repartition("low", "high").sortWithinPartitions("low", "high")
    both = stored(in_arrow(grouped, compare, "a long, b long, n long").where("a != b OR n > 0"), "exact")
    labels = components(both.where("a != b").select("a", "b"))
    return labels, stored(both.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "found")


def _truth(nodes: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """Number of links of every asked node (node, truth), counted over all nodes."""
    rows = asked.select("node", "vector").toPandas()
    names = rows["node"].to_numpy()
    lengths = np.array([len(v) for v in rows["vector"]])
    units = {}
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        values = np.stack([np.asarray(rows["vector"][r], np.float64) for r in places])
        units[length] = places, values / np.linalg.norm(values, axis=1, keepdims=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(names), np.int64)
        for whole in batches:
            for batch in _by_length(whole, 1):
                unit = _matrix(batch.column(1))
                places, mine = units.get(unit.shape[1], (None, None))
                if places is not None:
                    linked = mine @ unit.T >= threshold
                    linked &= names[places][:, None] != batch.column(0).to_numpy()[None, :]
                    totals[places] += (linked * batch.column(2).to_numpy()[None, :]).sum(1)
        yield encode_frame({"node": pa.array(names), "truth": pa.array(totals)})

    return in_arrow(nodes.select("node", "vector", "copies"), count, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))


def audit(nodes: DataFrame, found: DataFrame, threshold: float, hot: int, n: int) -> float:
    """Lowest recall of ``found`` (node, n) among the nodes asked, of which some have at most and some more than ``hot`` links.

    Nodes are asked until there were enough of both kinds, all of them where there are not.
    """
    parts = max(1, -(-n // DRAWN))
    seen, lowest = {False: 0, True: 0}, 1.0
    for part in range(parts):
        asked = nodes.where(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(parts)) == part)
        both = _truth(nodes, asked, threshold).where("truth > 0").join(found, "node", "left")
        for truth, have in both.select("truth", F.coalesce("n", F.lit(0))).collect():
            seen[truth > hot] += 1
            lowest = min(lowest, have / truth)
        if all(many >= ENOUGH for many in seen.values()):
            break
    return lowest


def link_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    k: int = 10,
    projections: int = 6,
    recall: float = 0.99,
    rounds: int = 4,
    tries: int = 3,
    exact_to: int = 0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id of the component), kept."""
    cast = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), cast.alias("vector"))
    # Adding zero makes -0.0 and 0.0 one value.
    keyed = rows.withColumn("usable", _usable(F.col("vector")))
    plus = F.transform("vector", lambda x: x + F.lit(0.0))
    keyed = keyed.withColumn("h1", F.xxhash64(plus)).withColumn("h2", F.xxhash64(F.lit("second"), plus))
    good = keyed.where("usable")
    groups = good.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("low_id"))
    nodes = stored(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")

    n = nodes.count()
    settled = n <= exact_to
    if settled:
        labels, found = _exact(nodes, threshold, n)
    lists: DataFrame | None = None
    for attempt in range(0 if settled else tries):
        for number in range(projections):
            more = _along_projection(nodes, attempt * projections + number, k)
            lists = more if lists is None else lists.unionByName(more)
        lists = stored(_keep_best(lists, k), "lists")
        for _ in range(rounds):
            better = stored(_refined(nodes, lists, k), "better")
            changed = better.count()
            lists = stored(_keep_best(lists.unionByName(better), k), "lists")
            if changed < 0.02 * k * n:
                break
        links = lists.where(F.col("sim") >= threshold).select(F.col("node").alias("a"), F.col("nbr").alias("b"))
        labels = components(links)
        roots = components(stored(_bridges(nodes, lists, labels, k, threshold), "bridges")).select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = stored(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        found = stored(_component_links(nodes, labels, threshold), "found")
        reached = audit(nodes, found, threshold, k, n)
        settled = reached >= recall
        if settled:
            break
    if not settled:
        labels, found = _exact(nodes, threshold, n)
    named = labels.join(nodes.select("node", "low_id"), "node")
    lows = stored(named.groupBy("label").agg(F.min("low_id").alias("component_low")), "lows")
    of_node = stored(
        nodes.drop("vector")
        .join(labels.join(lows, "label").select("node", "component_low"), "node", "left")
        .join(found, "node", "left")
        .select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_low", "low_id").alias("component_id")),
        "of-node",
    )
    linked = good.select("id", "h1", "h2").join(of_node, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = keyed.where(~F.coalesce("usable", F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
