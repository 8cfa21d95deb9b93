"""Tokenising whole texts with a public tokenizer, one library call per distinct segment.

A text is split at boundaries no token can cross, and every worker remembers the ids of
the segments it has met. The ids of a text are then a gather over that table. Only
segments met for the first time go to the library, in one batch per few megabytes of text.

Safe boundaries are known for two kinds of tokenizers; any other file is encoded text by
text:

* white space dropped (a normaliser that folds white space, a pre-tokenizer that keeps
  none of it): every space or line end is a boundary. Such texts are lower-cased at once
  where that provably gives what the tokenizer's own order of steps gives;
* byte-level words with a leading space: a space before a non-space character begins a
  word whatever stands before it.

In both kinds a comma or full stop between a letter or digit and white space is a word of
its own. A text that holds a string of the added tokens is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from boardpulse.llm.shared import kept

# Of the segments remembered by one worker, at most.
MOST_SEGMENTS = 500_000
# Bytes of new segments that go to the library at once.
BATCH_BYTES = 1 << 20

_ODD_SPACE = re.compile(r" (?!\S)")
_WORD_SPACE = re.compile(r" (?=\S)")
# The look-behind comes after the stop, so that the search goes from stop to stop and not from letter to letter.
_STOP = re.compile(r"[,.](?<=[^\W_][,.])(?=\s|$)")
# Begins a segment that has no space before it.
_BARE = "\0"
# Stands between segments.
_CUT = "\1"


def _kind(config: dict) -> str:
    normal, before = config.get("normalizer"), config.get("pre_tokenizer") or {}
    if normal is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"):
        return "leading"
    steps = (normal or {}).get("normalizers", [])
    folds = any(s.get("type") == "Replace" and s.get("pattern", {}).get("Regex") == r"\s+" for s in steps)
    splits = [p for p in before.get("pretokenizers", []) if p.get("type") == "Split"]
    plain = all(s.get("type") in ("NFC", "Replace", "Lowercase") for s in steps)
    if folds and plain and len(splits) == 1 and splits[0].get("behavior") == "Removed" and splits[0].get("invert"):
        return "dropped"
    return "whole"


class SegmentEncoder:
    """Ids of whole texts as the tokenizers library gives them, without added special tokens."""

    def __init__(self, path: str, with_ids: bool = True, most: int = MOST_SEGMENTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.kind = _kind(config)
        self.lowers = self.kind == "dropped" and any(
            s.get("type") == "Lowercase" for s in config["normalizer"]["normalizers"]
        )
        added = [t["content"] for t in config.get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.letters = _byte_letters() if self.kind != "whole" else {}
        self.with_ids = with_ids
        self.most = most
        self._forget()

    def _forget(self) -> None:
        # One row per segment; the segments themselves stay in Arrow and never all become Python strings.
        self.names = pa.array([], pa.large_string())
        self.flat = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _cut(self, text: str) -> str | None:
        """The text with ``_CUT`` at its safe boundaries; None if it has to stay whole."""
        if self.kind == "whole" or _BARE in text or _CUT in text or (self.special and self.special.search(text)):
            return None
        if self.kind == "dropped":
            if self.lowers and "Σ" not in text and unicodedata.is_normalized("NFC", text):
                small = text.lower()
                text = small if unicodedata.is_normalized("NFC", small) else text
            return _STOP.sub(_CUT + r"\g<0>", text).replace("\n", _CUT).replace(" ", _CUT)
        text = _BARE + _STOP.sub(" \0\\g<0>", text)
        return text.replace(" ", _CUT) if not _ODD_SPACE.search(text) else _WORD_SPACE.sub(_CUT, text)

    def _text(self, segment: str) -> str:
        if self.kind == "leading":
            return segment[1:] if segment.startswith(_BARE) else " " + segment
        return segment

    def _is_normal(self, word: str) -> bool:
        """Whether the tokenizer's normaliser leaves the word as it is."""
        return self.kind == "leading" or (
            unicodedata.is_normalized("NFC", word) and (not self.lowers or word == word.lower())
        )

    def _batches(self, texts: list[str]) -> Iterator[list[str]]:
        begin = size = 0
        for place, text in enumerate(texts):
            if size + len(text) > BATCH_BYTES and place > begin:
                yield texts[begin:place]
                begin, size = place, 0
            size += len(text)
        yield texts[begin:]

    def _by_library(self, texts: list[str]) -> Iterator[list[int] | range]:
        for batch in self._batches(texts):
            for found in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                yield found.ids if self.with_ids else range(len(found))

    def _learn(self, new: pa.LargeStringArray) -> None:
        """Give rows and ids to segments met for the first time."""
        if not len(new):
            return
        segments = new.to_pylist()
        texts = list(map(self._text, segments))
        ids: list = [None] * len(texts)
        rest = []
        merge = self.tokenizer.model.tokenize
        for place, segment in enumerate(segments):
            if self.with_ids and segment.isalpha() and self._is_normal(segment):  # one word: straight to the merges
                word = texts[place]
                if not (word.isascii() and word.isalpha()):  # such letters stand for themselves
                    word = word.encode().decode("latin-1").translate(self.letters)
                ids[place] = [token.id for token in merge(word)]
            else:
                rest.append(place)
        for place, found in zip(rest, self._by_library([texts[place] for place in rest])):
            ids[place] = found
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = len(self.flat)
        if self.with_ids:
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.concatenate([self.starts, begin + np.cumsum(lengths) - lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(ids), np.int64)])
        self.names = pa.concat_arrays([self.names, new])

    def _trim(self) -> None:
        """Beyond ``most`` segments keep those used most often, half as many at most."""
        if len(self.names) <= self.most:
            return
        keep = np.flatnonzero(self.uses >= 2)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(self.uses[keep], kind="stable")[-(self.most // 2) :]])
        names = self.names.take(pa.array(keep))
        flat = self._gather(keep)[0] if self.with_ids else self.flat
        uses, lengths = self.uses[keep] // 2, self.lengths[keep]
        self._forget()
        self.names, self.flat, self.lengths, self.uses = names, flat, lengths, uses
        self.starts = np.cumsum(lengths) - lengths

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64) + np.repeat(self.starts[rows] - ends + lengths, lengths)
        return self.flat[at], lengths

    def _look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """Table rows of all segments, how many each text has, and the ids of texts that stay whole."""
        self._trim()
        cut, whole = [], {}
        for place, text in enumerate(texts):
            ready = self._cut(text) if text else None
            if text and ready is None:
                whole[place] = self.tokenizer.encode(text, add_special_tokens=False).ids
            cut.append(ready)
        segments = pc.split_pattern(pa.array(cut, pa.large_string()), _CUT)
        sizes = pc.fill_null(pc.list_value_length(segments), 0).to_numpy().astype(np.int64)
        # Distinct segments of the batch are found and looked up in Arrow; only new ones come to Python.
        distinct = segments.flatten().dictionary_encode()
        found = pc.index_in(distinct.dictionary, value_set=self.names)
        is_new = found.is_null()
        row_of = found.fill_null(0).to_numpy().astype(np.int64)
        row_of[is_new.to_numpy(zero_copy_only=False)] = len(self.names) + np.arange(found.null_count)
        self._learn(distinct.dictionary.filter(is_new))
        places = distinct.indices.to_numpy()
        self.uses[row_of] += np.bincount(places, minlength=len(row_of))
        return row_of[places] if len(row_of) else np.zeros(0, np.int64), sizes, whole

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and the number of ids of each text; null counts as empty."""
        rows, sizes, whole = self._look_up(texts)
        ids, lengths = self._gather(rows)
        counts = _by_text(lengths, sizes)
        if whole:
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for place, found in whole.items():
                pieces[place] = np.array(found, np.uint32)
                counts[place] = len(found)
            ids = np.concatenate(pieces)
        return ids, counts

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        rows, sizes, whole = self._look_up(texts)
        counts = _by_text(self.lengths[rows], sizes)
        for place, found in whole.items():
            counts[place] = len(found)
        return counts


def _by_text(lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(lengths)])
    last = np.cumsum(sizes)
    return ends[last] - ends[last - sizes]


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (byte for byte in range(256) if byte not in printable)
    return {byte: chr(0x100 + place) for place, byte in enumerate(others)}


def encoder(name: str, with_ids: bool = True) -> SegmentEncoder:
    """The encoder of this worker for a tokenizer file, loaded once and kept while it does the same work."""
    if (name, with_ids) not in kept:
        kept[name, with_ids] = SegmentEncoder(tokenizer_path(name), with_ids)
    return kept[name, with_ids]


def tokenizer_path(name: str) -> str:
    """A file's place on this machine: an absolute path, or a name of the public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
