"""Token counts, token files and packing against whole-text encoding by the library."""

from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from boardpulse.llm import packing
from boardpulse.llm.segments import SegmentEncoder, encoder
from boardpulse.llm.shared import in_arrow
from boardpulse.llm.token_counts import token_counts
from boardpulse.llm.token_files import checksums, read_tokens, write_tokens
from boardpulse.session import run_dir

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = [
    "a  b", "a   b ", " a", "\n\n x\n y", "x<|endoftext|> y", "a  <|endoftext|>  b.", "don't, I'LL. it's.",
    "\u0130stanbul. J\u030cx, \u0391\u03a3. \u039f\u0394\u039f\u03a3, e\u0301. x\u0301,", "a\x1cb \x1c c", "  ", "1,000.5, 3.",
    "a\u00a0b", "...,,, a.,b", "\tq \t r", "\U0001f642 \U0001f642, ok.", "\u65e5\u672c\u8a9e. \u2460, \u00b2.", "x\0y z", "x\1y", "x_, y_.", "",
]
PAIRS = [(3, "Some words, some more."), (1, None), (2, ""), (5, "long " * 9000 + "end."), (4, "Some words, some more."), (4, "twin"), (None, "no id")]


@pytest.fixture(scope="module")
def library():
    return {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in (WORD, BYTE)}


@pytest.mark.parametrize("name", [WORD, BYTE])
@pytest.mark.parametrize("most", [3, 100_000])
def test_segments_equal_whole_texts(library, name, most):
    for _ in range(2):
        path = public_tokenizers.path(name)
        with_ids, lengths = SegmentEncoder(path, most=most), SegmentEncoder(path, with_ids=False, most=most)
        for texts in (ODD, ODD[::-1], [None]):
            ids, counts = with_ids.encode(texts)
            expected = [library[name].encode(t or "", add_special_tokens=False).ids for t in texts]
            assert ids.tolist() == [i for e in expected for i in e]
            assert counts.tolist() == lengths.count(texts).tolist() == [len(e) for e in expected]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_a_known_segment_takes_little_memory(name):
    letters = str.maketrans("0123456789", "abcdefghij")
    text = " ".join(str(n).translate(letters) for n in range(50_000))
    encoder = SegmentEncoder(public_tokenizers.path(name))
    encoder.encode(["warm up"])
    tracemalloc.start()
    try:
        encoder.encode([text])
        assert tracemalloc.get_traced_memory()[0] < 80 * 50_000
    finally:
        tracemalloc.stop()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aB,. \n\t'_-1\u03a3\u00e9\u0301\u4e2d\0\x1c", "<|endoftext|>"]), max_size=40).map("".join))
def test_any_text(text):
    for name in (WORD, BYTE):
        encoder = _encoders.setdefault(name, SegmentEncoder(public_tokenizers.path(name)))
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


_encoders: dict = {}


def test_token_counts(spark, make_docs, library):
    found = token_counts(make_docs(PAIRS, extra=True), BYTE, limit=9).collect()
    expected = []
    for i, t in PAIRS:
        n = len(library[BYTE].encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 9))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert token_counts(make_docs([])).count() == 0


def test_token_files_are_read_back_in_order(spark, make_docs, library):
    folder = run_dir(spark, "tokens")
    write_tokens(make_docs(PAIRS, extra=True), folder, WORD, end_id=1)
    rows = sorted(checksums(read_tokens(spark, folder)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 4, 5]
    start, texts = 0, {}
    for i, t in PAIRS:
        texts.setdefault(i, []).append([*library[WORD].encode(t or "", add_special_tokens=False).ids, 1])
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        assert r["ids_crc32"] in [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in texts[r["doc_id"]]]
    plan = read_tokens(spark, folder).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan  # metadata alone is read alone


def test_token_files_of_nothing(spark, make_docs):
    folder = run_dir(spark, "tokens")
    write_tokens(make_docs([]), folder)
    assert checksums(read_tokens(spark, folder)).count() == 0


def packed_rows(frame):
    return [r.asDict() | {"ids": np.frombuffer(r["ids"], "<u4").tolist()} for r in frame.collect()]


def check_packing(pieces, pairs, library, window):
    texts = {}
    for i, t in pairs:
        texts.setdefault(i, []).append([*library[WORD].encode(t or "", add_special_tokens=False).ids, 2])
    by_sequence: dict = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert any(ids[p["start"] : p["start"] + p["length"]] == p["ids"] and len(ids) == p["doc_tokens"] for ids in texts[p["doc_id"]])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sum(p["length"] for p in pieces) == sum(len(i) for ids in texts.values() for i in ids)
    return padding


@pytest.mark.parametrize("window", [16, 4096])
def test_packing_covers_every_id_once(spark, make_docs, library, window):
    assert check_packing(packed_rows(packing.pack(make_docs(PAIRS, extra=True), window=window)), PAIRS, library, window) == 0


def test_packing_of_nothing(make_docs):
    assert packing.pack(make_docs([])).count() == 0


def test_least_squares_reaches_an_exact_histogram():
    histogram = np.zeros(65, np.int64)
    for lengths, times in (((40, 24), 7), ((30, 20, 14), 5), ((32, 32), 3)):
        for n in lengths:
            histogram[n] += times
    table = packing.plan(histogram, 64)
    assert table.attrs["rest"] == 0 and table.attrs["windows"] == 15
    for length, rows in table.groupby("length"):
        covered = sorted((r.low, r.high) for r in rows.itertuples())
        assert covered[0][0] == 0 and covered[-1][1] == histogram[length]
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_a_worker_lets_go_of_what_other_work_kept(spark):
    rows = spark.range(0, 3, 1, 1)

    def held():
        import gc

        return sum(type(x).__name__ == "SegmentEncoder" for x in gc.get_objects())

    def encode(batches):
        for batch in batches:
            encoder(WORD).encode(["some words"])
            yield batch

    def other(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([held()] * batch.num_rows, pa.int64())], names=["id"])

    assert in_arrow(rows, encode, "id long").count() == 3
    assert {r["id"] for r in in_arrow(rows, other, "id long").collect()} == {0}
