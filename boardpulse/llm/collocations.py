"""Phrase collocations: pair tiles over frequency-ranked ids, taken level by level.

A level holds, per chunk of text and language, the distinct keys of the chunk with their
counts, and the chunk as a sequence of places in that list (-1 where a phrase cannot go on).
Level 1 has the words as keys. From one level to the next:

1. the counts of all chunks are added up; keys below ``least`` leave, since no longer phrase
   can be more frequent than its parts; the rest is ranked by frequency;
2. the ranks go back to the chunks that hold the keys, joined on the chunk, so that a task
   knows only the keys of its own chunk and nothing that grows with the corpus is broadcast;
3. neighbours in a chunk's sequence are counted in tiles of TILE x TILE ranks. Well-filled
   tiles among the frequent ranks are addressed directly (one ``bincount`` per tile), all
   others as sorted coordinates. The pairs are the keys of the next level: two neighbouring
   phrases of m words share m - 1 of them, so their pair is a phrase of m + 1 words.

Chunks bound the memory of a task whatever the text sizes; a very frequent word brings one
row per chunk to a shuffle. Counts, scores and ranks are exact (integers, decimals of 38
digits). Levels are written to the shared folder.

Defined results: a null language counts as ``und``; null and empty texts have no words;
repeated rows count each; an empty table gives an empty result; other columns are ignored;
equal scores go by count, then by phrase in UTF-8 byte order. One text is never cut, so a
chunk is as large as its largest text if that exceeds the chunk size.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardpulse.llm.shared import encode_frame, in_arrow, slices, stored
from boardpulse.operators.numbering import number_rows

# A-Z; where pieces end (. , ; : ! ? and the line breaks \n to \r).
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(UPPER + ENDS, LOWER + b"\n" * len(ENDS))
NO_LANGUAGE = "und"

CHUNK_BYTES = 16 << 20
TILE = 1024
# Tiles along one side of the directly addressed area, and how full a tile has to be for it.
GRID, FULL_ENOUGH = 16, 16
CHUNK_BITS = 32

WORDS = "chunk long, lang string, keys array<binary>, counts array<long>, seq binary"
# Pairs as packed numbers: one value per chunk and column, not one per pair.
PAIRS = "chunk long, lang string, left binary, right binary, counts binary, seq binary"
COUNTS = "left long, right long, n long"
HELD = "chunk long, place int, left long, right long"


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


class _Chunk:
    """Words of one language met by a task since the last emission."""

    def __init__(self) -> None:
        self.places, self.seq = _Places(), array("i")

    def add(self, text: bytes) -> None:
        for piece in text.translate(FOLD).split(b"\n"):
            # Without line breaks only blanks and tabs are left for split() to cut at.
            words = piece.split()
            if words:
                self.seq.extend(map(self.places.__getitem__, words))
                self.seq.append(-1)


def _array_of(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def _row(chunk: int, lang: str, keys: pa.Array, counts: np.ndarray, seq: np.ndarray) -> pa.RecordBatch:
    columns = [
        pa.array([chunk], pa.int64()),
        pa.array([lang], pa.string()),
        _array_of(keys, [len(keys)]),
        _array_of(pa.array(counts, pa.int64()), [len(keys)]),
        pa.array([seq.astype(np.int32).tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "keys", "counts", "seq"])


def chunk_words(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """Level 1: one row, with a number of its own, per chunk of about ``most`` bytes and language."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, open_chunks = TaskContext.get().partitionId(), 0, 0, {}

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang, chunk in open_chunks.items():
                number += 1
                seq = np.frombuffer(chunk.seq, np.int32)
                counts = np.bincount(seq[seq >= 0], minlength=len(chunk.places))
                yield _row((part << CHUNK_BITS) + number, lang, pa.array(list(chunk.places), pa.binary()), counts, seq)

        for whole in batches:
            for batch in slices(whole, 1):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not text:
                        continue
                    if held and held + len(text) > most:
                        yield from rows()
                        held, open_chunks = 0, {}
                    if lang not in open_chunks:
                        open_chunks[lang] = _Chunk()
                    open_chunks[lang].add(text)
                    held += len(text)
        yield from rows()

    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    rows = docs.select(lang, F.col(text_column).cast("string").cast("binary").alias("text"))
    return in_arrow(rows, cut, WORDS)


def tiles(x: np.ndarray, y: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ranks below ``m`` as x * m + y, their counts, and each input pair's place among them."""
    # Narrow numbers throughout: a task's memory is a few times one of these arrays.
    x, y = x.astype(np.int32, copy=False), y.astype(np.int32, copy=False)
    inverse = np.empty(len(x), np.int32)
    codes, counts, taken = [], [], 0
    left = np.ones(len(x), bool)
    near = (x < GRID * TILE) & (y < GRID * TILE)
    tile = np.full(len(x), -1, np.int16)
    tile[near] = (x[near] // TILE) * GRID + y[near] // TILE
    filled = np.bincount(tile[near], minlength=GRID * GRID) if near.any() else np.zeros(GRID * GRID, np.int64)
    for t in np.flatnonzero(filled >= TILE * TILE // FULL_ENOUGH).tolist():
        inside = tile == t
        cells = (x[inside] % TILE) * TILE + y[inside] % TILE
        dense = np.bincount(cells, minlength=TILE * TILE)
        met = np.flatnonzero(dense)
        place = np.cumsum(dense > 0) - 1
        inverse[inside] = place[cells] + taken
        codes.append((met // TILE + t // GRID * TILE) * m + met % TILE + t % GRID * TILE)
        counts.append(dense[met])
        taken += len(met)
        left &= ~inside
    del near, tile
    # As np.unique with inverse and counts, which would hold three more arrays of this size.
    sparse = x[left].astype(np.int64) * m
    sparse += y[left]
    order = np.argsort(sparse)
    sparse = sparse[order]
    first = np.ones(len(sparse), bool)
    np.not_equal(sparse[1:], sparse[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    sparse, times = sparse[starts], np.diff(starts, append=len(order))
    places = np.empty(len(order), np.int32)
    places[order] = np.cumsum(first, dtype=np.int32) + np.int32(taken - 1)
    inverse[left] = places
    return np.concatenate([*codes, sparse]), np.concatenate([*counts, times]), inverse


def _numbers(column: pa.Array, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)


def _chunk_pairs(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Neighbours in one chunk (chunk, lang, seq, known): left and right ids, counts, and the sequence of their places."""
    known = batch.column(3).slice(k, 1).flatten()
    ids, places = (known.field(name).to_numpy(zero_copy_only=False) for name in ("id", "place"))
    seq = _numbers(batch.column(2), k, np.int32)
    # Places of the chunk's list to ranks within the chunk; the last entry stands for -1.
    rank = np.full(max(int(seq.max(initial=-1)), int(places.max(initial=-1))) + 2, -1, np.int32)
    rank[places] = np.arange(len(places))
    ranked = rank[seq]
    met = (ranked[:-1] >= 0) & (ranked[1:] >= 0)
    if not met.any():
        return None
    x, y = ranked[:-1][met], ranked[1:][met]
    del ranked, rank
    codes, counts, inverse = tiles(x, y, len(ids))
    del x, y
    following = np.full(len(met), -1, np.int32)
    following[met] = inverse
    return ids[codes // len(ids)], ids[codes % len(ids)], counts, following


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next level of each chunk."""
    for batch in batches:
        for k in range(batch.num_rows):
            if found := _chunk_pairs(batch, k):
                packed = {name: pa.array([part.tobytes()], pa.binary()) for name, part in zip(("left", "right", "counts", "seq"), found)}
                yield encode_frame({"chunk": batch.column(0).slice(k, 1), "lang": batch.column(1).slice(k, 1), **packed})


def _last_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only the counts of each chunk: where no longer phrase is wanted nothing has to be kept."""
    for batch in batches:
        for k in range(batch.num_rows):
            if found := _chunk_pairs(batch, k):
                yield from _cut({"left": found[0], "right": found[1], "n": found[2]})


def _cut(columns: dict[str, np.ndarray], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for begin in range(0, size, rows):
        yield encode_frame({name: pa.array(values[begin : begin + rows]) for name, values in columns.items()})


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield from _cut({name: _numbers(batch.column(c), k, np.int64) for c, name in enumerate(("left", "right", "n"))})


def _pair_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            left, right = (_numbers(batch.column(c), k, np.int64) for c in (1, 2))
            chunk = np.full(len(left), batch.column(0)[k].as_py(), np.int64)
            yield from _cut({"chunk": chunk, "place": np.arange(len(left), dtype=np.int32), "left": left, "right": right})


def _counted(counts: DataFrame, least: int, by: list[str]) -> DataFrame:
    """Keys of at least ``least`` occurrences with ``f``, numbered from 1 by frequency."""
    sums = counts.groupBy(*by).agg(F.sum("n").alias("f"))
    frequent = stored(sums.where(F.col("f") >= least).withColumn("rarity", -F.col("f")), "frequent")
    return stored(number_rows(frequent, ["rarity", *by], "id", F.lit(0)).drop("rarity"), "ranked")


def _known(level: DataFrame, held: DataFrame, ranked: DataFrame, by: list[str]) -> DataFrame:
    """Each chunk's sequence with those of its keys that are frequent, by rank."""
    known = held.join(ranked.select("id", *by), by).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("id", "place"))).alias("known"))
    return level.select("chunk", "lang", "seq").join(known, "chunk").select("chunk", "lang", "seq", "known")


def _score(a: Column, left: Column, right: Column, scale: int) -> Column:
    wide = "decimal(19,0)"
    over = (a.cast(wide) * a.cast(wide)).cast("decimal(38,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", over, (left.cast(wide) * right.cast(wide)).cast("decimal(38,0)"))


def mine_phrases(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    covered_percent: int = 50,
    scale: int = 1_000_000,
    lang_column: str = "lang",
    text_column: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """All collocations: lang, phrase, a, l, r, n, score.

    Phrases of 2 to ``longest`` words with ``a >= least`` occurrences, cut where floor(scale *
    a * a / (l * r)) is lowest. One that occurs to ``covered_percent`` or more within a single
    longer candidate is left out; looking one word further is enough, as every longer phrase
    runs through a phrase of that length which is no rarer.
    """
    level = stored(chunk_words(docs, lang_column, text_column, chunk_bytes), "words")
    totals = stored(level.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n")), "totals")
    by = ["lang", "key"]
    entry = level.select("lang", F.explode(F.arrays_zip("keys", "counts")).alias("entry"))
    ranked = _counted(entry.select("lang", F.col("entry.keys").alias("key"), F.col("entry.counts").alias("n")), least, by)
    none = F.array().cast("array<long>")
    phrases = ranked.select(
        "id", "lang", F.col("key").cast("string").alias("phrase"), F.col("key").cast("string").alias("last"), "f",
        none.alias("heads"), none.alias("tails"),
    )
    held = level.select("chunk", "lang", F.posexplode("keys").alias("place", "key"))
    candidates, covers = [], []
    for words in range(2, longest + 1):
        known = _known(level, held, ranked, by)
        by = ["left", "right"]
        if words < longest:
            level = stored(in_arrow(known, _pairs, PAIRS), "pairs")
            ranked = _counted(in_arrow(level.select("left", "right", "counts"), _pair_counts, COUNTS), least, by)
            held = in_arrow(level.select("chunk", "left", "right"), _pair_places, HELD)
        else:
            ranked = _counted(in_arrow(known, _last_pairs, COUNTS), least, by)
        head = phrases.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.col("f").alias("head_f"), "heads")
        tail = phrases.select(F.col("id").alias("right"), "last", F.col("f").alias("tail_f"), "tails")
        phrases = stored(
            ranked.join(head, "left").join(tail, "right").select(
                "id", "left", "right", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f",
                F.concat("heads", F.array("head_f")).alias("heads"), F.concat("tails", F.array("tail_f")).alias("tails"),
            ),
            "phrases",
        )
        cuts = [
            F.struct(
                _score(F.col("f"), F.col("heads")[k], F.col("tails")[words - 2 - k], scale).alias("score"),
                F.lit(k).alias("k"), F.col("heads")[k].alias("l"), F.col("tails")[words - 2 - k].alias("r"),
            )
            for k in range(words - 1)
        ]
        candidates.append(phrases.select("id", "lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("cut")))
        covers.append(
            phrases.select(F.col("left").alias("id"), "f").unionByName(phrases.select(F.col("right").alias("id"), "f"))
            .groupBy("id").agg(F.max("f").alias("most"))
        )
    kept = []
    for k, frame in enumerate(candidates):
        if k + 1 < len(candidates):
            frame = frame.join(covers[k + 1], "id", "left")
            frame = frame.where((100 * F.coalesce("most", F.lit(0)) < covered_percent * F.col("a")))
        kept.append(frame.select("lang", "phrase", "a", "cut"))
    every = kept[0]
    for frame in kept[1:]:
        every = every.unionByName(frame)
    return every.join(totals, "lang").select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )


def top_phrases(phrases: DataFrame, first: int = 2000) -> DataFrame:
    """The ``first`` phrases of each language with their ``rank``.

    All phrases are numbered in range partitions, so no language has to fit a task; a
    language's ranks start behind the languages before it.
    """
    ordered = stored(phrases.withColumns({"worse": -F.col("score"), "rarer": -F.col("a")}), "scored")
    numbered = stored(number_rows(ordered, ["lang", "worse", "rarer", "phrase"], "number", F.lit(0)), "numbered")
    starts = numbered.groupBy("lang").agg((F.min("number") - 1).alias("before"))
    ranked = numbered.join(starts, "lang").withColumn("rank", F.col("number") - F.col("before"))
    return ranked.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
