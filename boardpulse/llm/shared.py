"""Helpers of the operators: shipping the package to workers, stored intermediates, columns."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardpulse.session import run_dir

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Workers then import it by name, so what a module keeps (tokenizers, word codes) lives
    as long as the worker and not only as long as one task.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="boardpulse-code-"), "boardpulse.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def stored(frame: DataFrame, purpose: str, partitions: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write ``frame`` as Parquet into the folder all executors share and read it back.

    Cuts the lineage like a checkpoint, but columnar and compressed, so that later stages
    read only the columns they need. A lost executor costs a new read, not a new run.
    """
    spark = frame.sparkSession
    folder = run_dir(spark, purpose)
    frame.write.options(**{"compression": "zstd", **options}).partitionBy(*partitions).parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


Work = Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]
# Of this worker: whose tasks it ran last, and what they keep for the next ones.
_owner: str | None = None
kept: dict = {}


def give_back() -> None:
    """Free memory goes back to the machine: workers outlive their tasks, and an executor holds several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def in_turn(work: Work) -> Work:
    """``work`` that leaves no free memory behind in its worker, nor what earlier tasks of other work kept there."""
    name = f"{work.__module__}.{work.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By its name, so that it is this worker's module and no copy sent along with the function.
        from boardpulse.llm import shared

        if shared._owner != name:
            shared.kept.clear()
            gc.collect()
            shared.give_back()
            shared._owner = name
        try:
            yield from work(batches)
        finally:
            shared.give_back()

    return run


def in_arrow(frame: DataFrame, work: Work, schema: str) -> DataFrame:
    """``mapInArrow`` after the package was shipped."""
    ship(frame.sparkSession)
    return frame.mapInArrow(in_turn(work), schema)


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` into runs of rows whose texts hold about ``most`` bytes; a longer text stays whole."""
    texts = batch.column(column)
    begin = size = 0
    for row, length in enumerate(pc.binary_length(texts).to_pylist()):
        length = length or 0
        if size and size + length > most:
            yield batch.slice(begin, row - begin)
            begin, size = row, 0
        size += length
    if begin < batch.num_rows:
        yield batch.slice(begin)


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows cut where the first ``n_keys`` integer columns change, one batch per group.

    For groups of bounded size only; the rows of the last group wait for the next batch.
    """
    left: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([left, table]).combine_chunks() if left is not None else table
        keys = np.stack([table.column(k).to_numpy() for k in range(n_keys)])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist()]
        for begin, end in zip(cuts, cuts[1:]):
            yield table.slice(begin, end - begin).combine_chunks().to_batches()[0]
        left = table.slice(cuts[-1])
    if left is not None:
        yield left.combine_chunks().to_batches()[0]


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def encode_frame(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
