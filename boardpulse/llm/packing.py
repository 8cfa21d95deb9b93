"""Packing documents into windows: shallow length combinations solved against the histogram.

1. Every text is encoded once and stored with its end id. Full windows are cut off its
   front; what is left, 1 to ``window`` - 1 ids, is its tail.
2. The histogram of tail lengths covers all documents and has fewer than ``window``
   entries, whatever their number. Combinations of up to three equal or different lengths
   that fill a window exactly are enumerated from the lengths that occur. Non-negative
   least squares gives how often each is used, so that together they come closest to the
   histogram; the counts are rounded down and trimmed to what is there.
3. Tails the combinations leave over are packed greedily: laid end to end, longest
   length first, and cut where a window is full. The last window is cut into powers of
   two, which need no padding.

Which window a tail goes to follows from its length and its number among the tails of
that length; numbers come from counts per (length, part), never from a window over all
documents. Ids are moved once, to meet their placement.

Defined results: a null or empty text is one end id; repeated rows are packed each; an
empty table gives no pieces; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardpulse.llm.segments import encoder
from boardpulse.llm.shared import encode_frame, in_arrow, slices, stored

WINDOW = 4096
# Combinations of three are built over this many of the most frequent lengths.
TRIPLE_LENGTHS = 160
ENCODED = "part int, row long, doc_id long, n long, ids binary"


def encode_rows(docs: DataFrame, tokenizer: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """Rows numbered within their part, with ids as little-endian unsigned 32-bit integers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, row = encoder(tokenizer), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, 1):
                ids, counts = ids_of.encode(batch.column(1).to_pylist())
                data, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                values = [data[e - 4 * n : e] + tail for e, n in zip(ends, counts.tolist())]
                yield encode_frame(
                    {
                        "part": pa.array(np.full(len(values), part), pa.int32()),
                        "row": pa.array(np.arange(row, row + len(values)), pa.int64()),
                        "doc_id": batch.column(0),
                        "n": pa.array(counts + 1, pa.int64()),
                        "ids": pa.array(values, pa.binary()),
                    }
                )
                row += len(values)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return in_arrow(rows, encode, ENCODED)


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Length combinations that fill a window: rows of three lengths, 0 for none.

    All pairs whose two lengths occur, and all triples over the most frequent lengths
    whose third length occurs as well.
    """
    occurs = histogram > 0
    lengths = np.flatnonzero(occurs)
    short = lengths[2 * lengths <= window]
    pairs = [(window - a, a, 0) for a in short.tolist() if occurs[window - a]]
    often = lengths[np.argsort(-histogram[lengths], kind="stable")[:TRIPLE_LENGTHS]]
    a, b = np.meshgrid(often, often, indexing="ij")
    a, b = a[a >= b], b[a >= b]
    c = window - a - b
    fits = (c > 0) & (c <= b)
    a, b, c = a[fits], b[fits], c[fits]
    known = occurs[c]
    triples = np.stack([a[known], b[known], c[known]], 1)
    return np.concatenate([np.array(pairs, np.int64).reshape(-1, 3), triples]).astype(np.int64)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares: counts x >= 0 with the lengths of all combinations nearest the histogram.

    Minimises |A x - h|^2 by accelerated projected gradients; A has at most three entries
    per column and is never built.
    """
    if not len(combos):
        return np.zeros(0)

    def spread(x: np.ndarray) -> np.ndarray:
        out = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=len(histogram))[: len(histogram)]
        out[0] = 0
        return out

    goal = histogram.astype(float).copy()
    goal[0] = 0
    # Largest eigenvalue of A'A: at most the largest column sum times the largest row sum of A.
    rows = np.bincount(combos.ravel(), minlength=len(histogram))
    rows[0] = 0
    step = 1.0 / (3 * rows.max())
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        gap = spread(y) - goal
        gap[0] = 0
        new = np.maximum(0, y - step * gap[combos].sum(1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, window: int) -> pd.DataFrame:
    """Ranges of numbers of each length and where they go.

    Columns: length, low, high (numbers of that length, high excluded), base (window of
    number low), offset (in the window); base -1 marks the greedy rest, whose first number
    lies at ``offset`` in the row of all left-over tails.
    """
    combos = combinations(histogram, window)
    wanted = np.floor(solve_counts(combos, histogram) + 0.5).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros(len(histogram), np.int64)
    rows, windows = [], 0
    for place in np.argsort(-wanted, kind="stable").tolist():
        lengths = [n for n in combos[place].tolist() if n]
        times = min(int(wanted[place]), min(int(left[n]) // lengths.count(n) for n in lengths))
        if times <= 0:
            continue
        offset = 0
        for n in lengths:
            rows.append((n, used[n], used[n] + times, windows, offset))
            used[n] += times
            left[n] -= times
            offset += n
        windows += times
    rest = 0
    for n in np.flatnonzero(left)[::-1].tolist():
        rows.append((n, used[n], used[n] + left[n], -1, rest))
        rest += n * int(left[n])
    table = pd.DataFrame(rows, columns=["length", "low", "high", "base", "offset"]).astype("int64")
    table.attrs.update(windows=windows, rest=rest)
    return table


def last_cuts(rest: int, window: int) -> list[int]:
    """Where the greedy rest is cut inside its last window: powers of two, largest first."""
    begin = rest // window * window
    cuts, left = [begin], rest - begin
    while left:
        cuts.append(cuts[-1] + (1 << (left.bit_length() - 1)))
        left -= 1 << (left.bit_length() - 1)
    return cuts


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, unsigned 32-bit)."""
    spark = docs.sparkSession
    rows = stored(encode_rows(docs, tokenizer, end_id, id_column, text_column), "packing-ids")
    light = rows.select("part", "row", "n", (F.col("n") % window).alias("tail"))

    counts = stored(
        light.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("number"), F.sum((F.col("n") / window).cast("long")).alias("full")),
        "packing-counts",
    )
    # Fewer than ``window`` rows.
    found = counts.where("tail > 0").groupBy("tail").agg(F.sum("number").alias("number")).toPandas()
    histogram = np.zeros(window + 1, np.int64)
    histogram[found["tail"].to_numpy(np.int64)] = found["number"].to_numpy(np.int64)
    table = plan(histogram, window)
    combined, rest = table.attrs["windows"], table.attrs["rest"]
    cuts = last_cuts(rest, window)

    # Numbers of each length before a part, and full windows before a part: sums over parts.
    earlier = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "tail", F.coalesce(F.sum("number").over(earlier), F.lit(0)).alias("before"))
    per_part = counts.groupBy("part").agg(F.sum("full").alias("full"))
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full_before = per_part.select("part", F.coalesce(F.sum("full").over(in_order), F.lit(0)).alias("full_before"))

    # Number of a tail within (length, part): a group is part of one stored part.
    within = Window.partitionBy("part", "tail").orderBy("row")
    numbered = light.withColumn("local", F.row_number().over(within) - 1).join(before, ["part", "tail"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("local"))
    # The plan has fewer than four rows per combination, at most a few thousand combinations.
    ranges = spark.createDataFrame(table if len(table) else table.reindex([0]).fillna(0).astype("int64"))
    placed = numbered.join(
        F.broadcast(ranges),
        (F.col("tail") == F.col("length")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")),
        "left",
    )
    shift = F.col("number") - F.col("low")
    tail_start = F.col("n") - F.col("tail")

    def piece(start, length, sequence, offset):  # noqa: ANN001, ANN202
        columns = {"start": start, "length": length, "sequence_id": sequence, "offset": offset}
        return F.struct(*[F.lit(v).cast("long").alias(k) if isinstance(v, int) else v.cast("long").alias(k) for k, v in columns.items()])

    combo_piece = F.array(piece(tail_start, F.col("tail"), F.col("base") + shift, F.col("offset")))
    # A left-over tail covers [at, at + tail) of the rest; windows and the last cuts divide it.
    at = F.col("offset") + shift * F.col("tail")
    first, last = F.floor(at / window), F.floor((at + F.col("tail") - 1) / window)
    marks = F.concat(
        F.transform(F.sequence(first, last), lambda w: (w * window).cast("long")),
        F.array(*[F.lit(c).cast("long") for c in cuts[1:]]) if len(cuts) > 1 else F.array().cast("array<long>"),
    )
    inside = F.array_sort(
        F.array_distinct(F.concat(F.array(at), F.filter(marks, lambda m: (m > at) & (m < at + F.col("tail")))))
    )
    final = F.lit(rest // window)
    small = F.array(*[F.lit(c).cast("long") for c in cuts])

    def rest_piece(begin, place):  # noqa: ANN001, ANN202
        end = F.coalesce(F.get(inside, (place + 1).cast("int")), at + F.col("tail"))
        in_last = F.floor(begin / window) >= final
        order = F.size(F.filter(small, lambda c: c <= begin)) - 1
        sequence = F.lit(combined) + F.when(in_last, final + order).otherwise(F.floor(begin / window))
        zero = F.when(in_last, F.get(small, order)).otherwise(F.floor(begin / window) * window)
        return piece(tail_start + begin - at, end - begin, sequence, begin - zero)

    rest_pieces = F.transform(inside, rest_piece)
    base = combined + rest // window + max(0, len(cuts) - 1)
    # Full windows are numbered after all others, by part and row.
    running = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    fulls = light.where(F.col("n") >= window).withColumn("count", (F.col("n") / window).cast("long"))
    fulls = fulls.withColumn("mine", F.coalesce(F.sum("count").over(running), F.lit(0))).join(full_before, "part")
    full_pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("count") - 1),
        lambda k: piece(k * window, F.lit(window), F.lit(base) + F.col("full_before") + F.col("mine") + k, F.lit(0)),
    )
    tails = placed.where("tail > 0").select(
        "part", "row", F.when(F.col("base") >= 0, combo_piece).otherwise(rest_pieces).alias("pieces")
    )
    pieces = tails.unionByName(fulls.select("part", "row", full_pieces.alias("pieces"))).select("part", "row", F.inline("pieces"))
    joined = pieces.join(rows.select("part", "row", "doc_id", F.col("n").alias("doc_tokens"), "ids"), ["part", "row"])
    cut = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return joined.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", cut.alias("ids"))
