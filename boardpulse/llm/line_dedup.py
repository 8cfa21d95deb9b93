"""Repeated lines: levelled sorted runs of line hashes, merged with each new batch.

A run holds, in buckets sorted by hash, each line key once with the number of documents that
have it. A batch of documents is reduced to such counts, merge-anti-joined with the runs there
are (keys a run already counts often enough need no more counting) and added as a run of
level 0; the buckets of runs meet those of the batch without a shuffle of the runs. When a
level has ``fanout`` runs they are merged, bucket with bucket, into one of the next level, so a
key is rewritten once per level. Which runs count says a commit log, so a lost writer leaves no half run.

A text's own lines are then matched with the keys of all runs that reach ``least_docs``:
occurrences and keys are both shuffled, so the engine can split a line that stands in a third
of all documents. Texts move once, to meet the list of their dropped lines.

A key is the line with ASCII white space stripped at both ends and A-Z lower-cased, as a
128-bit hash; different keys share one in a trillion lines with a chance below 1e-14.

Defined results: null and empty texts are one empty line; empty keys are never dropped; every
row is a document of its own, also where ids or texts repeat; a null id stays null; an empty
table gives an empty result; other columns are ignored. A text is never cut, so the longest
one has to fit a task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardpulse.llm.shared import encode_frame, in_arrow, slices, stored
from boardpulse.session import run_dir
from boardpulse.sources.commitlog import CommitLog, Entry, Part

# Fixed value: what is stripped from the ends of a line.
BLANK = b" \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
ROW = ["row1", "row2"]
LINES = "row1 long, row2 long, place int, first boolean, h1 long, h2 long"


class LineRuns:
    """The runs of one corpus below ``root``; a second object on the same root goes on with them."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.log = CommitLog(spark, root)
        # As many buckets as a shuffle has partitions, so that a batch meets the runs as it falls.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, counts: DataFrame, level: int) -> Part:
        name = f"line_run_{uuid.uuid4().hex}"
        part = Part(f"runs/{name}", level=level, more={"table": name, "buckets": self.buckets})
        writer = counts.select(*HASH, "n").write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet")
        writer.option("path", self.log.folder(part)).option("compression", "zstd").saveAsTable(name)
        return part

    def _read(self, part: Part) -> DataFrame:
        """The run as a bucketed table; its name is only known to the session that registers it."""
        name = part.more["table"]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {int(part.more['buckets'])} BUCKETS "
                f"LOCATION '{self.log.folder(part)}'"
            )
        return self.spark.table(name)

    def runs(self) -> list[Part]:
        return list(self.log.newest().parts)

    def add(self, counts: DataFrame, least: int) -> None:
        """Take in the counts (h1, h2, n; each key once) of a new batch, then compact where it is due."""
        for part in self.runs():
            settled = self._read(part).where(F.col("n") >= least)
            counts = counts.join(settled, HASH, "left_anti")
        run = self._write(counts, 0)
        self.log.commit(lambda entry: entry.with_parts((run,)))
        self.compact()

    def compact(self) -> None:
        """Merge the runs of every level that has ``fanout`` of them."""
        while True:
            levels: dict[int, list[Part]] = {}
            for part in self.runs():
                levels.setdefault(part.level, []).append(part)
            due = [level for level, parts in sorted(levels.items()) if len(parts) >= self.fanout]
            if not due:
                return
            old = tuple(levels[due[0]])
            merged = self._write(self._sums(old), due[0] + 1)

            def swap(entry: Entry) -> Entry | None:
                here = {part.path for part in entry.parts}
                return entry.with_parts((merged,), old) if all(part.path in here for part in old) else None

            self.log.commit(swap)
            for part in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {part.more['table']}")

    def _sums(self, parts: tuple[Part, ...]) -> DataFrame:
        # Full outer joins merge bucket with bucket; a union would have to be shuffled by hash again.
        every = self._read(parts[0])
        for part in parts[1:]:
            other = self._read(part).withColumnRenamed("n", "more")
            total = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
            every = every.join(other, HASH, "full_outer").select(*HASH, total.alias("n"))
        return every

    def settled(self, least: int) -> DataFrame:
        """The keys counted in ``least`` documents or more, over all runs."""
        parts = tuple(self.runs())
        if not parts:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._sums(parts).where(F.col("n") >= least).select(*HASH)

    def close(self) -> None:
        """Take the tables out of the session's catalog; the files stay."""
        for part in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {part.more['table']}")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 2):
            owners, places, firsts, digests = [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                met: set[bytes] = set()
                for place, line in enumerate(text.lower().split(b"\n") if text else ()):
                    key = line.strip(BLANK)
                    if key:
                        owners.append(k)
                        places.append(place)
                        firsts.append(key not in met)
                        met.add(key)
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            owner = pa.array(owners, pa.int64())
            yield encode_frame(
                {
                    "row1": batch.column(0).take(owner),
                    "row2": batch.column(1).take(owner),
                    "place": pa.array(places, pa.int32()),
                    "first": pa.array(firsts, pa.bool_()),
                    "h1": pa.array(both[:, 0]),
                    "h2": pa.array(both[:, 1]),
                }
            )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            n_lines, n_dropped, kept = [], [], []
            for text, dropped in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = (text or b"").split(b"\n")
                gone = set(dropped or ())
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                kept.append(b"\n".join([line for k, line in enumerate(lines) if k not in gone]) if gone else text or b"")
            yield encode_frame(
                {
                    "id": batch.column(0),
                    "n_lines": pa.array(n_lines, pa.int64()),
                    "n_dropped": pa.array(n_dropped, pa.int64()),
                    "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )


def drop_repeated_lines(
    docs: DataFrame,
    least_docs: int = 10,
    batches: int = 6,
    runs: LineRuns | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: id, ``n_lines`` before, ``n_dropped``, and ``kept``, the text without lines found in ``least_docs`` documents.

    The documents are taken into the runs in ``batches`` parts by a hash of the row; runs of
    earlier calls count along.
    """
    spark = docs.sparkSession
    runs = runs or LineRuns(spark, run_dir(spark, "line-runs"))
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text.cast("binary").alias("text")).select(
        # Rows with equal id and text may share their key: the same lines leave them.
        F.xxhash64(F.lit(0), "id", "text").alias("row1"), F.xxhash64(F.lit(1), "id", "text").alias("row2"), "id", "text"
    )
    lines = in_arrow(rows.select(*ROW, "text"), _hashed, LINES)
    lines = stored(lines.withColumn("batch", F.pmod("row1", F.lit(batches)).cast("int")), "lines", partitions=("batch",))
    for batch in range(batches):
        counts = lines.where((F.col("batch") == batch) & F.col("first")).groupBy(*HASH).agg(F.count("*").alias("n"))
        runs.add(counts, least_docs)
    repeated = stored(runs.settled(least_docs), "repeated-lines")
    gone = lines.join(repeated, HASH, "left_semi").groupBy(*ROW).agg(F.collect_set("place").alias("gone"))
    result = in_arrow(rows.join(stored(gone, "dropped-lines"), ROW, "left").select("id", "text", "gone"), _without, "id long, n_lines long, n_dropped long, kept string")
    runs.close()
    return result.withColumnRenamed("id", id_column)
