"""Periodic runs of words: sparse diagonals, one latest earlier occurrence per word and context.

A run is a maximal stretch of words with smallest period q whose length reaches both
``least_words`` and ``least_periods`` times q. In the table of word pairs (i, j) that hold the
same word, a run is a stretch of the diagonal i - j = q. Walking the diagonals of all earlier
occurrences of a word is quadratic in frequent words, so each word is looked up together with
the words before it: at level L = 16, 32, 64, ... a word counts as occurring again where the
last L words are the same. Only its latest earlier occurrence matters there:

* a run of period q <= L with at least 3 q words repeats its last L words exactly q back, and
  no nearer (two periods q' < q in a stretch of q' + L words would make q' a period of all);
* the levels take the periods from L / 2 + 1 to L (the first level: up to L), so that every
  run of that period is long enough to hold a repeated context.

Every word thus lengthens at most one diagonal per level: the one its context occurred on
last. Where the lag changes, the diagonal ends and, long enough, is emitted at once. The work
is n log n per text in numpy; contexts are pairs of exact ranks, never hashes. Texts of a
batch are walked together; words that repeat no 16 words before leave after the first level.

No shuffle: one pass over the texts. Defined results: null, empty and blank texts have no
words and no runs; repeated rows are treated each; an empty table gives an empty result; a
null id stays null; other columns are ignored; equal ratios go to the smallest start, then
the smallest period. A text is never cut: a very long one is held by its task as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.llm.shared import encode_frame, in_arrow, slices

# Words of context at the first level.
CONTEXT = 16
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
SCHEMA = (
    "id long, runs array<struct<start:long,length:long,period:long>>, best long, n_words long, kept string"
)


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The dense rank of each pair."""
    _, ranks = np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)
    return ranks


def _previous(contexts: np.ndarray, places: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the latest earlier place of the same context in the same text (else 0), and who repeats or is repeated."""
    order = np.argsort(contexts, kind="stable")
    sorted_places = places[order]
    gaps = np.diff(sorted_places)
    same = (np.diff(contexts[order]) == 0) & (sorted_places[:-1] > breaks[sorted_places[1:]])
    lags = np.zeros(len(places), np.int64)
    lags[order[1:]] = np.where(same, gaps, 0)
    again = np.zeros(len(places), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return lags, again


def _ended(at: np.ndarray, lag: np.ndarray, width: int) -> np.ndarray:
    """Stretches of neighbouring places on one diagonal, as rows of start, length, period."""
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(lag) != 0)) + 1
    begin, end = np.r_[0, cuts], np.r_[cuts, len(at)] - 1
    period = lag[begin]
    start = at[begin] - (width - 1) - period
    return np.stack([start, at[end] - start + 1, period], 1)


def diagonals(words: np.ndarray, least_words: int, least_periods: int) -> np.ndarray:
    """Runs of ``words`` (numbers from 0, -1 between texts) as rows of start, length, period."""
    found = [np.empty((0, 3), np.int64)]
    every = np.arange(len(words))
    breaks = np.maximum.accumulate(np.where(words < 0, every, -1)) if len(words) else every
    depth = every - breaks
    ranks = np.full(len(words), -1, np.int64)
    places = every[words >= 0]
    contexts, width = words[places], 1
    while len(places):
        if width < CONTEXT:
            again = np.bincount(contexts)[contexts] > 1
        else:
            lags, again = _previous(contexts, places, breaks)
            taken = (lags > (0 if width == CONTEXT else width // 2)) & (lags <= width)
            if taken.any():
                ended = _ended(places[taken], lags[taken], width)
                long_enough = ended[:, 1] >= np.maximum(least_words, least_periods * ended[:, 2])
                found.append(ended[long_enough])
        # Only contexts that occur again can be parts of longer ones that do.
        keep = places[again]
        ranks[:] = -1
        ranks[keep] = contexts[again]
        keep = keep[depth[keep] >= 2 * width]
        keep = keep[ranks[keep - width] >= 0]
        contexts, places, width = _ranks(ranks[keep], ranks[keep - width]), keep, 2 * width
    return np.concatenate(found)


def _best(runs: np.ndarray) -> int:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    best = 0
    for k in range(1, len(runs)):
        left, right = int(runs[k, 1]) * int(runs[best, 2]), int(runs[best, 1]) * int(runs[k, 2])
        if left > right:
            best = k
    return best


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside all runs, and the first period of each run where no other run drops it."""
    if not len(runs):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()])


def find_runs(
    docs: DataFrame,
    least_words: int = 24,
    least_periods: int = 3,
    rewrite: Rewrite | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: id, ``runs`` (by start, then period), ``best`` (place of the strongest run or null),
    ``n_words`` and ``kept`` (the text without repetitions, words joined by one space).

    Words are stretches without ASCII white space. ``rewrite`` may change the words of a text first.
    ``least_periods`` is 3 at least: below, the latest occurrence would not name every period.
    """
    if least_periods < 3 or least_words < 24:
        raise ValueError("runs need at least 3 periods and 24 words")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                yield _walk(batch, least_words, least_periods, rewrite)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return in_arrow(rows, walk, SCHEMA).withColumnRenamed("id", id_column)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _walk(batch: pa.RecordBatch, least_words: int, least_periods: int, rewrite: Rewrite | None) -> pa.RecordBatch:
    numbers, flat, texts, begins = _Numbers(), [], [], []
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        words = text.split() if text else []
        if rewrite and words:
            words = rewrite(key, words)
        texts.append(words)
        begins.append(len(flat))
        flat.extend(map(numbers.__getitem__, words))
        flat.append(-1)
    found = diagonals(np.array(flat, np.int64), least_words, least_periods)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    owners = np.searchsorted(begins, found[:, 0], side="right") - 1
    cuts = np.searchsorted(owners, np.arange(len(texts) + 1))
    found[:, 0] -= np.array(begins, np.int64)[owners] if len(found) else 0
    kept, best = [], []
    for k, words in enumerate(texts):
        runs = found[cuts[k] : cuts[k + 1]]
        best.append(_best(runs) if len(runs) else None)
        kept.append(_collapsed(words, runs))
    runs = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(3)], ["start", "length", "period"])
    return encode_frame(
        {
            "id": batch.column(0),
            "runs": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs),
            "best": pa.array(best, pa.int64()),
            "n_words": pa.array([len(words) for words in texts], pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )


def looped(key: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text by the crc32 of its id gets a loop; used by the registered query. A null id changes nothing."""
    if key is None:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]

