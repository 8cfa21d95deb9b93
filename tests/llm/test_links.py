"""Near-duplicates of texts and vectors, components and chat formatting against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from boardpulse.llm import chat, near_dup, vector_links
from boardpulse.llm.components import components
from boardpulse.llm.queries import HOSTILE, QUERIES
from boardpulse.llm.vector_links import link_vectors


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_equals_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint32)
        b = list(a)
        for _ in range(rng.integers(0, 4)):
            if rng.random() < 0.5:
                b.insert(rng.integers(0, len(b) + 1), rng.integers(0, 30))
            elif len(b) > 1:
                b.pop(rng.integers(0, len(b)))
        x, y = near_dup.kmers(a), near_dup.kmers(np.array(b, np.uint32))
        common = common_subsequence(x.tolist(), y.tolist())
        assert near_dup.aligned(x, y) == (common / (len(x) + len(y) - common) >= 0.8 - 1e-9)


def test_order_minhash_equals_sorting():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 3, 5, 40, 3000])
    values = rng.integers(0, 2**63, sizes.sum(), dtype=np.int64).astype(np.uint64)
    found = near_dup.order_minhash(values, sizes)
    for k, begin in enumerate(np.cumsum(sizes) - sizes):
        own = values[begin : begin + sizes[k]]
        for table in range(near_dup.TABLES):
            seed = near_dup._mixed(np.array([table + 1], np.uint64) * near_dup._ODD[3])[0]
            chosen = np.sort(np.argsort(near_dup._mixed(own ^ seed))[: near_dup.DEPTH])
            key = near_dup._mixed(np.array([(own[chosen] * near_dup._ODD[: len(chosen)]).sum() + np.uint64(table)]))[0]
            assert found[k, table] == key


def brute_classes(texts):
    codes = near_dup._Codes()
    runs = [near_dup.kmers(near_dup.word_codes(t, codes)) for t in texts]
    label = list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            same = near_dup.aligned(runs[x], runs[y]) if len(runs[x]) and len(runs[y]) else not len(runs[x]) and not len(runs[y]) and (texts[x] or "") == (texts[y] or "")
            if same and label[x] != label[y]:
                low, high = sorted((label[x], label[y]))
                label = [low if v == high else v for v in label]
    return label


def some_texts(seed, groups=12, copies=14):
    rng = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(30)]
    out = []
    for g in range(groups):
        base = [f"w{rng.integers(0, 5000)}" for _ in range(rng.integers(20, 150))] + (passage if g % 2 else [])
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.integers(0, 8)):
                words[rng.integers(0, len(words))] = f"e{rng.integers(0, 10**6)}"
            out.append(" ".join(words))
    return out + [None, "", "", "!!", "!!", "one", "One!", "two three"]


@pytest.mark.parametrize("group", [4, near_dup.GROUP])
def test_classes_equal_brute_force(spark, make_docs, monkeypatch, group):
    monkeypatch.setattr(near_dup, "GROUP", group)
    texts = some_texts(group)
    found = near_dup.near_duplicates(make_docs(list(enumerate(texts)), extra=True)).collect()
    assert [r["class_id"] for r in sorted(found, key=lambda r: r["doc_id"])] == brute_classes(texts)
    assert all(r["kept"] == (r["class_id"] == r["doc_id"]) for r in found)


def short_texts(seed, bases=120):
    """Titles and captions, each with and without one word before, after or exchanged."""
    rng = np.random.default_rng(seed)
    out = []
    for b in range(bases):
        words = [f"b{b}w{k}" for k in range(rng.integers(8, 45))]
        line = ["all", "of", "them", "share", "this", "line"] if b % 3 == 0 else []
        out += [" ".join(line + words), " ".join([*line, f"x{b}", *words]), " ".join([*line, *words, f"y{b}"])]
        words[-1] = f"z{b}"
        out.append(" ".join(line + words))
    return out


def test_short_near_duplicates_equal_brute_force(make_docs):
    texts = short_texts(3)
    found = near_dup.near_duplicates(make_docs(list(enumerate(texts)))).collect()
    assert [r["class_id"] for r in sorted(found, key=lambda r: r["doc_id"])] == brute_classes(texts)


def test_near_duplicates_of_odd_rows(make_docs):
    rows = [(None, "same text here as there"), (2, "same text here as there"), (2, "same text here as there"), (3, None), (4, "")]
    found = near_dup.near_duplicates(make_docs(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["kept"]) for r in found) == [(0, 2, False), (2, 2, True), (2, 2, True), (3, 3, True), (4, 3, False)]
    assert sorted(r["doc_id"] for r in near_dup.drop_near_duplicates(make_docs(rows)).collect()) == [2, 3]
    assert near_dup.near_duplicates(make_docs([])).count() == 0


def test_rows_that_share_an_id_stay_if_their_texts_differ(make_docs):
    rows = [(None, "the first text without an id"), (None, "a second one, quite different"), (None, "named copy of words"), (1, "named copy of words")]
    rows += [(2, "two texts under one id"), (2, "this is the other of them"), (3, "equal rows here"), (3, "equal rows here"), (None, None), (None, "the first text without an id")]
    kept = near_dup.drop_near_duplicates(make_docs(rows, extra=True)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted({(i or 0, t or "") for i, t in rows} - {(0, "named copy of words")})


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3), (7, None)]
    rows = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert rows == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    for k in range(70):  # one large group, far beyond a neighbour list
        rows.append((100 + k, (base[0] + rng.normal(scale=0.05, size=16)).tolist()))
    rows += [(300, base[1].tolist()), (301, base[1].tolist()), (302, (2 * base[1]).tolist())]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [1.0, 2.0]), (405, [2.0, 4.0]), (406, [])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    found = {r["vec_id"]: r for r in link_vectors(frame).collect()}
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    for i, v in rows:
        links = [
            j for j, w in good.items()
            if i in good and j != i and len(w) == len(good[i]) and w @ good[i] / np.linalg.norm(w) / np.linalg.norm(good[i]) >= 0.9
        ]
        assert found[i]["n_links"] == len(links), i
        assert found[i]["component_id"] <= min([i, *links]) and found[i]["kept"] == (found[i]["component_id"] == i)
    assert link_vectors(frame.limit(0)).count() == 0


@pytest.fixture
def by_lists(monkeypatch):
    """Neighbour lists for small tables too, taken whatever their audit says."""
    monkeypatch.setattr(vector_links, "audit", lambda *_: 1.0)
    return {"exact_to": 0}


def nested_groups(seed, groups, members, dims=16):
    """Vectors all linked with each other, in tight groups larger than a neighbour list."""
    rng = np.random.default_rng(seed)
    near = lambda v, scale: v / np.linalg.norm(v) + rng.normal(scale=scale / np.sqrt(dims), size=dims)
    top = rng.normal(size=dims)
    return np.array([near(centre, 0.01) for centre in (near(top, 0.15) for _ in range(groups)) for _ in range(members)])


def test_links_between_saturated_groups(spark, by_lists):
    vectors = np.concatenate([nested_groups(6, 12, 20), nested_groups(7, 3, 30)])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in link_vectors(frame, **by_lists).collect()}
    assert [found[k]["n_links"] for k in range(len(vectors))] == (links.sum(1) - 1).tolist()
    assert {found[k]["component_id"] for k in range(240)} == {0} and {found[k]["component_id"] for k in range(240, 330)} == {240}


def test_poor_lists_are_not_accepted(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "BLOCK", 1)  # no node meets another: lists stay empty
    vectors = np.concatenate([nested_groups(8, 4, 15), np.random.default_rng(8).normal(size=(300, 16))])
    vectors = np.concatenate([vectors, vectors[60:] + 0.01])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in link_vectors(frame, tries=1, exact_to=0).collect()}
    assert links[60:].any() and [found[k]["n_links"] for k in range(len(vectors))] == links.tolist()
    assert {found[k]["component_id"] for k in range(60)} == {0}


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "\nyes <|im_end|>"), (1, None, "system", None), (2, 0, "assistant", ""), (2, 1, None, "x" * 50_000),
    (3, 5, "assistant", HOSTILE), (3, 5, "assistant", HOSTILE), (None, 0, "assistant", "alone"), (4, 0, "us\ner<|n", "<|\\ \u00e9\U0001f642<"),
]


def test_chats_come_back_and_masks_hold_the_assistant(spark):
    rows = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "conv_id long, turn long, role string, text string, spans string, turns string")
    formatted = chat.format_chats(rows)
    found = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    groups: dict = {}
    for conv, turn, role, text in sorted(ROWS, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0)):
        groups.setdefault(conv, []).append((role or "", text or ""))
    assert set(found) == set(groups)
    for conv, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        row = found[conv]
        assert (row["n_turns"], row["loss_chars"]) == (len(turns), len(loss))
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for r in formatted.collect():
        touching = [any(b < s["end"] and e > s["begin"] for s in r["spans"]) and e > b for b, e in zip(r["token_begins"], r["token_ends"])]
        assert r["loss_mask"] == touching
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_registered_link_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    found = {r["doc_id"]: r["class_id"] for r in QUERIES["op1_order_minhash"](spark, sf).collect()}
    ids = [r["doc_id"] for r in docs]
    assert [found[i] for i in ids] == [ids[k] for k in brute_classes([r["text"] for r in docs])]


def test_small_tables_are_answered_by_neighbour_lists(spark, monkeypatch):
    dice = np.random.default_rng(8)
    centres = dice.standard_normal((30, 16))
    vectors = np.concatenate([centre + 0.1 * dice.standard_normal((1 + k % 7, 16)) for k, centre in enumerate(centres)])
    monkeypatch.setattr(vector_links, "_exact", lambda *_: pytest.fail("compared all pairs instead"))
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    found = {r["vec_id"]: r["n_links"] for r in link_vectors(frame).collect()}
    assert found == {n: int(row.sum()) - 1 for n, row in enumerate(linked)}
