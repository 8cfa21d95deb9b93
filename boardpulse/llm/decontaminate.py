"""Benchmark decontamination over templates: re-parameterised questions count as leaks.

A text becomes a row of template words: lower-cased words, with numbers, units and names
(capitalised words inside a sentence, a run of them counting once) replaced by typed
placeholders. Windows of ``WINDOW`` template words are hash-joined with the windows of
the benchmark items; a window with fewer than ``LITERAL`` words that are not placeholders
joins nothing. For the windows of an item found in a text, the values in the slots have to
be consistent: a value of the item stands for one value of the text and the other way
round, as the majority of the windows has it. An item leaks into a text if at least
``share`` of its windows are found that way, or if a run of ``RUN`` words of it is. An item
shorter than a window is one window. The first word of an item may be a name inside a
sentence of the text, so an item that begins with a capitalised word is searched both ways.

Items without a usable window are searched verbatim: all their words in order, whatever
case and punctuation. Those of fewer than ``LITERAL`` words have to stand between sentence
or line ends, or the ends of the text. Such a leak counts as one window of one.

The benchmark side of the join is held in the tasks. Its size is checked: beyond
``MOST_WINDOWS`` windows it is cut into blocks of whole items and the documents are read
once per block, so nothing is dropped. Documents are not shuffled and never leave their
task but as leaks found.

Defined results: null and empty texts leak nothing; null and empty items, and items without
words, are never found; repeated rows are judged each; empty tables give no leaks; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.llm.shared import encode_frame, in_arrow, stored

WINDOW = 8
LITERAL = 4
SHARE = 0.5
RUN = 13
MOST_WINDOWS = 1_000_000
MOST_WORDS = 600_000

# Words that are typed placeholders.
UNITS = frozenset(
    "mm cm m km mg g kg t ml l s ms min h hz khz mhz ghz w kw kb mb gb tb inch inches foot feet yard yards mile miles "
    "ounce ounces pound pounds meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram "
    "kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year "
    "years percent dollar dollars euro euros cent cents".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty "
    "ninety hundred thousand million billion".split()
)

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LITERAL, _NUMBER, _UNIT, _NAME, _END = 0, 1, 2, 3, 4
_PLACEHOLDER = np.array([0, 11, 22, 33, 44], np.uint64)


class _Words(dict):
    """Token to a row of hashes and kinds; kinds of capitalised words depend on their place."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[tuple[int, int]] = []  # not in the tables yet
        self.filled = 0
        self.hashes = np.empty(1 << 12, np.uint64)
        self.kinds = np.empty(1 << 12, np.int8)

    def __missing__(self, token: str) -> int:
        row = self[token] = len(self)
        small = token.lower()
        if token in ".!?\n":
            kind = _END
        elif token[0].isdigit() or small in NUMBERS:
            kind = _NUMBER
        elif small in UNITS:
            kind = _UNIT
        else:
            kind = _NAME if token[0].isupper() and token[1:].islower() else _LITERAL
        self.new.append((xxhash.xxh64_intdigest(small.encode("utf-8", "replace")), kind))
        return row

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and kind of every row; only new rows are written, into tables that double."""
        end = self.filled + len(self.new)
        if end > len(self.hashes):
            more = max(end, 2 * len(self.hashes))
            self.hashes, self.kinds = np.resize(self.hashes, more), np.resize(self.kinds, more)
        if self.new:
            hashes, kinds = zip(*self.new)
            self.hashes[self.filled : end] = np.array(hashes, np.uint64)
            self.kinds[self.filled : end] = kinds
            self.filled = end
            self.new.clear()
        return self.hashes, self.kinds


# Words met by this worker, over all its tasks.
_met = _Words()


def template(text: str | None, words: _Words, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, kinds and value hashes of a text, sentence ends removed.

    ``inside``: the text begins inside a sentence.
    """
    tokens = _TOKEN.findall(text or "")
    rows = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    hashes, kinds = words.tables()
    values, kind = hashes[rows], kinds[rows]
    ends = kind == _END
    starts = np.concatenate([[True], ends[:-1]])[: len(rows)]
    if inside:
        starts[:1] = False
    kind = np.where((kind == _NAME) & starts, _LITERAL, kind)
    again = np.concatenate([[False], (kind[1:] == _NAME) & (kind[:-1] == _NAME)])[: len(rows)]
    keep = ~ends & ~again
    values, kind = values[keep], kind[keep]
    return np.where(kind == _LITERAL, values, _PLACEHOLDER[kind]), kind, values


def verbatim(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text, and whether a sentence, a line or the text ends before each and after the last."""
    tokens = _TOKEN.findall(text or "")
    rows = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    hashes, kinds = words.tables()
    ends = kinds[rows] == _END
    begins = np.concatenate([[True], ends[:-1]])[: len(rows)][~ends]
    return hashes[rows][~ends], np.concatenate([begins, [True]])


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` template words."""
    count = len(codes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for place in range(size):
        out *= _BASE
        out += codes[place : place + count]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


@dataclass
class TemplateIndex:
    """Windows of a block of items: sorted hashes with item and place, and the slot values of each item."""

    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    sizes: np.ndarray
    totals: dict[int, int]
    slots: dict[int, tuple[np.ndarray, np.ndarray]]
    item_ids: list[int]
    whole: dict[int, dict[int, list[int]]]

    @classmethod
    def build(cls, texts: list[tuple[int, str | None]], window: int = WINDOW) -> TemplateIndex:
        words, parts, totals, slots = _Words(), [], {}, {}
        whole: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for number, (_, text) in enumerate(texts):
            # Entry 2 n is item n, entry 2 n + 1 the same inside a sentence.
            forms = [template(text, words), template(text, words, inside=True)]
            if np.array_equal(forms[0][1], forms[1][1]):
                forms.pop()
            usable = False
            for entry, (codes, kind, values) in enumerate(forms, 2 * number):
                size = min(window, len(codes))
                if size < LITERAL:
                    continue
                literal = np.convolve(kind == _LITERAL, np.ones(size, int), "valid") >= LITERAL
                places = np.flatnonzero(literal)
                if not len(places):
                    continue
                found = window_hashes(codes, size)[places]
                columns = (found, np.full(len(places), entry), places, np.full(len(places), size))
                parts.append(np.stack([column.astype(np.uint64) for column in columns], 1))
                totals[entry], slots[entry] = len(places), (kind, values)
                usable = True
            if not usable:
                plain, _ = verbatim(text, words)
                if len(plain):
                    whole[len(plain)][int(window_hashes(plain, len(plain))[0])].append(number)
        rows = np.concatenate(parts) if parts else np.zeros((0, 4), np.uint64)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        ints = rows[:, 1:].astype(np.int64)
        return cls(rows[:, 0], ints[:, 0], ints[:, 1], ints[:, 2], totals, slots, [item for item, _ in texts], {size: dict(found) for size, found in whole.items()})

    def matcher(self) -> Callable[[str | None], list[tuple[int, int, int]]]:
        """A function from a text to what it holds of items: item id, windows found, windows of the item."""
        holds = self._holds()
        return lambda text: [held[:3] for held in holds(text)]

    def leaks(self, share: float) -> Callable[[str | None], list[tuple[int, int, int]]]:
        """A function from a text to its leaks: item id, windows found, windows of the item."""
        holds = self._holds()
        return lambda text: [held[:3] for held in holds(text) if held[1] >= share * held[2] or held[3] >= RUN]

    def _holds(self) -> Callable[[str | None], list[tuple[int, int, int, int]]]:
        """A function from a text to item id, windows found, windows of the item, words of the longest run."""
        words, lengths = _met, np.unique(self.sizes).tolist()
        shift = np.uint64(44)
        seen = np.zeros(1 << 20, bool)
        seen[(self.hashes >> shift).astype(np.int64)] = True

        def match(text: str | None) -> list[tuple[int, int, int, int]]:
            if not text or not (len(self.hashes) or self.whole):
                return []
            if len(words) > MOST_WORDS:
                words.clear()
                words.__init__()
            codes, kind, values = template(text, words)
            pairs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for size in lengths:
                found = window_hashes(codes, size)
                at = np.flatnonzero(seen[(found >> shift).astype(np.int64)])
                low = np.searchsorted(self.hashes, found[at], "left")
                high = np.searchsorted(self.hashes, found[at], "right")
                for place, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                    for row in range(a, b):
                        if self.sizes[row] == size:
                            pairs[int(self.items[row])].append((int(self.places[row]), place, size))
            best: dict[int, tuple[int, int, int]] = {}
            for entry, matches in pairs.items():
                consistent, run = self._consistent(entry, matches, kind, values)
                if consistent:
                    held, number = (consistent, self.totals[entry], run), entry // 2
                    old = best.get(number, held)
                    better = max(held, old, key=lambda x: x[0] / x[1])
                    best[number] = (better[0], better[1], max(run, old[2]))
            if self.whole:
                plain, begins = verbatim(text, words)
                for size, items in self.whole.items():
                    for place, found in enumerate(window_hashes(plain, size).tolist()):
                        if found in items and (size >= LITERAL or begins[place] and begins[place + size]):
                            best.update((number, (1, 1, size)) for number in items[found])
            return [(self.item_ids[number], *held) for number, held in best.items()]

        return match

    def _consistent(self, number: int, matches: list[tuple[int, int, int]], kind: np.ndarray, values: np.ndarray) -> tuple[int, int]:
        """How many windows of the item are found with the values most windows agree on, and the words of their longest run."""
        item_kind, item_values = self.slots[number]
        filled = [
            (place, at, size, [(int(item_values[place + k]), int(values[at + k])) for k in range(size) if item_kind[place + k] != _LITERAL])
            for place, at, size in matches
        ]
        votes = Counter(pair for *_, pairs in filled for pair in pairs)
        there, back = {}, {}
        for (mine, other), _ in votes.most_common():
            if mine not in there and other not in back:
                there[mine], back[other] = other, mine
        good = [(at - place, place, size) for place, at, size, pairs in filled if all(there.get(mine) == other for mine, other in pairs)]
        longest, begin, last = 0, 0, None
        for shift, place, size in sorted(good):
            if last != (shift, place - 1):
                begin = place
            last, longest = (shift, place), max(longest, place + size - begin)
        return len({place for _, place, _ in good}), longest


def blocks(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", most: int = MOST_WINDOWS) -> Iterator[TemplateIndex]:
    """The benchmark as indexes of at most about ``most`` windows, whole items each, one at a time."""
    rows = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(text_column).cast("string").alias("text"))
    texts, size = [], 0
    for row in rows.where("text IS NOT NULL AND item IS NOT NULL").orderBy("item", "text").toLocalIterator():
        if texts and size + len(row.text) // 2 > most:
            yield TemplateIndex.build(texts)
            texts, size = [], 0
        texts.append((row.item, row.text))
        size += len(row.text) // 2
    if texts:
        yield TemplateIndex.build(texts)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document row and leaked item: id, item_id, matched, windows."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = "id long, item_id long, matched long, windows long"

    def search(index: TemplateIndex) -> DataFrame:
        def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = index.leaks(share)
            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out.extend((doc, *leak) for leak in match(text))
                columns = list(zip(*out)) or [(), (), (), ()]
                names = ("id", "item_id", "matched", "windows")
                yield encode_frame({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

        return in_arrow(rows, leaks, schema)

    found: DataFrame | None = None
    for index in blocks(benchmark):
        part = search(index)
        found = part if found is None else stored(found, "leaks").unionByName(stored(part, "leaks"))
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_column)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` into which no item leaks, with all their columns."""
    place = docs.columns.index(text_column)

    def without(kept: DataFrame, index: TemplateIndex) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = index.leaks(share)
            for batch in batches:
                clean = [not match(t) for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return in_arrow(kept, keep, docs.schema)

    kept = docs
    for number, index in enumerate(blocks(benchmark)):
        kept = without(stored(kept, "kept") if number else kept, index)
    return kept
