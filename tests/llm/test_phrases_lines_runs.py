"""Repeated lines, collocations and periodic runs against plain brute force, and on odd input."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardpulse.llm import collocations
from boardpulse.llm.collocations import mine_phrases, tiles, top_phrases
from boardpulse.llm.line_dedup import LineRuns, drop_repeated_lines
from boardpulse.llm.periodic_runs import diagonals, find_runs, looped
from boardpulse.llm.queries import QUERIES
from boardpulse.session import run_dir

ODD = [None, "", " ", "\n", "\n\n", "a", "A a\ta", "é É", "x" * 5000]


def clashing(docs):
    """Further columns with the names the operators use inside."""
    for name in ("id", "row1", "h1", "n", "place", "gone", "batch", "runs", "best", "kept", "key", "chunk", "left", "f", "seq"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


# -- repeated lines -----------------------------------------------------------------


def brute_lines(texts, least):
    blank = " \t\n\x0b\x0c\r"

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))

    found = Counter()
    for text in texts:
        found.update({key(line) for line in (text or "").split("\n")} - {""})
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not (key(line) and found[key(line)] >= least)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lines_found(frame):
    return sorted((r["doc_id"] is None, r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in frame.collect())


@pytest.mark.parametrize("batches", [1, 4])
def test_lines_against_brute_force(spark, make_docs, batches):
    dice = random.Random(batches)
    common = ["Home | About", " home | about\t", "ÄB", "äb", "©", "\x0bfoo\r", "FOO"]
    texts = ODD + ["\n".join(dice.choice(common + [f"line {dice.randrange(40)}"]) for _ in range(dice.randrange(9))) for _ in range(60)]
    texts += ["same\ntext"] * 5 + ["\n".join(["again"] * 50)]
    docs = clashing(make_docs(list(enumerate(texts))))
    for least in (2, 5):
        found = drop_repeated_lines(docs, least, batches)
        expected = sorted((False, i, *row) for i, row in enumerate(brute_lines(texts, least)))
        assert lines_found(found) == expected


def test_repeated_rows_are_documents_and_null_ids_stay(spark, make_docs):
    rows = [(1, "a\nb")] * 3 + [(None, "a\nc"), (None, "a\nc"), (1, "b")]
    found = lines_found(drop_repeated_lines(make_docs(rows), least_docs=4, batches=2))
    assert found == sorted((i is None, i, *row) for (i, _), row in zip(rows, brute_lines([t for _, t in rows], 4)))


def test_no_documents_no_lines(make_docs):
    assert drop_repeated_lines(make_docs([])).collect() == []


def test_runs_are_levelled_and_survive_the_session_object(spark):
    root = run_dir(spark, "levels")
    counts = [spark.createDataFrame([(k, -k, 1) for k in range(b, b + 6)], "h1 long, h2 long, n long") for b in range(7)]
    for batch in counts[:4]:
        LineRuns(spark, root, fanout=2).add(batch, 3)
    again = LineRuns(spark, root, fanout=2)
    for part in again.runs():
        spark.sql(f"DROP TABLE {part.more['table']}")  # as another session would find it
    for batch in counts[4:]:
        again.add(batch, 3)
    assert sorted(part.level for part in again.runs()) == [0, 1, 2]
    true = Counter(k for b in range(7) for k in range(b, b + 6))
    assert {row["h1"] for row in again.settled(3).collect()} == {k for k, n in true.items() if n >= 3}


def test_a_batch_meets_the_runs_without_shuffling_them(spark):
    runs = LineRuns(spark, run_dir(spark, "plan"))
    batch = spark.range(50_000).select("id", (-F.col("id")).alias("h2"), F.lit(1).cast("long").alias("n")).withColumnRenamed("id", "h1")
    runs.add(batch, 2)
    stored = runs._read(runs.runs()[0])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = batch.groupBy("h1", "h2").agg(F.count("*").alias("n"))
        plan = counts.join(stored.where("n >= 2"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


# -- collocations -------------------------------------------------------------------


def brute_phrases(rows, longest, least, percent=50, scale=1_000_000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(end, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    counts[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang, found in counts.items():
        chosen = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        for phrase, a in chosen.items():
            if any(
                len(longer) > len(phrase) and 100 * f >= percent * a
                and any(longer[k : k + len(phrase)] == phrase for k in range(len(longer) - len(phrase) + 1))
                for longer, f in chosen.items()
            ):
                continue
            score, _, l, r = min((scale * a * a // (found[phrase[:k]] * found[phrase[k:]]), k, found[phrase[:k]], found[phrase[k:]]) for k in range(1, len(phrase)))
            out.append((lang, " ".join(phrase), a, l, r, totals[lang], score))
    return sorted(out)


def phrases_found(frame):
    return sorted(tuple(row[c] for c in ("lang", "phrase", "a", "l", "r", "n", "score")) for row in frame.collect())


@pytest.fixture
def prose(spark):
    dice = random.Random(11)
    words = ["the", "The", "of", "new", "york", "city", "état", "É", "a", "x y"] + [f"w{k}" for k in range(30)]
    rows = [("en", None), ("en", ""), (None, "new york new york. new york"), ("de", "\t \n")]
    for _ in range(150):
        pieces = []
        for _ in range(dice.randrange(1, 8)):
            piece = [dice.choice(words[: dice.choice([5, 10, 40])]) for _ in range(dice.randrange(1, 9))]
            if dice.random() < 0.4:
                piece += ["new", "York", "city"][: dice.choice([2, 3])]
            pieces.append(dice.choice([" ", "  ", "\t"]).join(piece))
        rows.append((dice.choice(["en", "en", "de", None]), dice.choice([". ", "\n", "; "]).join(pieces)))
    rows += rows[-3:]
    docs = spark.createDataFrame([(n, text, lang) for n, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")
    return rows, clashing(docs.repartition(3))


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_against_brute_force(prose, longest):
    rows, docs = prose
    expected = brute_phrases(rows, longest, 4)
    assert len(expected) > 20
    # Chunks of a few texts, so that counts meet over many chunks.
    assert phrases_found(mine_phrases(docs, longest, least=4, chunk_bytes=2_000)) == expected


def test_rank_per_language(prose):
    rows, docs = prose
    expected = defaultdict(list)
    for lang, phrase, a, *_, score in brute_phrases(rows, 3, 4):
        expected[lang].append((-score, -a, phrase.encode()))
    top = top_phrases(mine_phrases(docs, 3, least=4, chunk_bytes=2_000), first=7)
    found = {(r["lang"], r["rank"]): r["phrase"].encode() for r in top.collect()}
    assert found == {(lang, k + 1): row[2] for lang, ranked in expected.items() for k, row in enumerate(sorted(ranked)[:7])}


def test_no_phrases(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert top_phrases(mine_phrases(docs)).collect() == []
    few = spark.createDataFrame([(1, "one two three", "en")], docs.schema)
    assert top_phrases(mine_phrases(few)).collect() == []


def test_scores_beyond_64_bits(spark):
    from boardpulse.llm.collocations import _score

    a, l, r = 3 * 10**12, 5 * 10**12, 7 * 10**12
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(_score(F.col("a"), F.col("l"), F.col("r"), 1_000_000)).first()
    assert row[0] == 1_000_000 * a * a // (l * r)


def test_tiles_take_little_memory():
    import tracemalloc

    dice = np.random.default_rng(1)
    ranks = np.minimum((dice.pareto(1.0, 1_000_001) * 50).astype(np.int64), 200_000)
    tracemalloc.start()
    codes, _, inverse = tiles(ranks[:-1], ranks[1:], 200_001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (codes[inverse] == ranks[:-1] * 200_001 + ranks[1:]).all()
    assert peak < 51 * 1_000_000


@pytest.mark.parametrize("ranks", [50, 3000, 40_000])
def test_tiles_count_like_a_counter(monkeypatch, ranks):
    monkeypatch.setattr(collocations, "TILE", 64)  # several filled tiles, several sparse ones
    numbers = np.random.default_rng(ranks)
    x, y = (np.minimum(numbers.zipf(1.3, 40_000), ranks) - 1 for _ in range(2))
    codes, counts, inverse = tiles(x, y, ranks)
    assert dict(zip(codes.tolist(), counts.tolist())) == Counter((x * ranks + y).tolist())
    assert (codes[inverse] == x * ranks + y).all() and len(set(codes.tolist())) == len(codes)


# -- periodic runs ------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, length = i - q, j - i + q
            inside = words[s:j]
            if length >= max(24, 3 * q) and not any(inside[p:] == inside[:-p] for p in range(1, q)):
                out.append((s, length, q))
            i = j
    return sorted(out, key=lambda run: (run[0], run[2]))


def repetitive(dice):
    words = []
    for _ in range(dice.randrange(6)):
        period = [f"w{dice.randrange(dice.choice([1, 2, 3, 50]))}" for _ in range(dice.randint(1, 40))]
        if dice.random() < 0.3:
            period = period * 3 + ["z"]
        words += (period * 6)[: dice.randint(0, len(period) * 6)]
        words += [f"v{dice.randrange(3)}" for _ in range(dice.choice([0, 0, 1, 30]))]
    return words


def test_diagonals_against_brute_force():
    dice = random.Random(5)
    for _ in range(400):
        texts = [repetitive(dice) for _ in range(dice.choice([1, 1, 3]))]
        if dice.random() < 0.3:
            texts.append(texts[0])
        numbers, flat, begins = {}, [], []
        for words in texts:
            begins.append(len(flat))
            flat += [numbers.setdefault(word, len(numbers)) for word in words] + [-1]
        expected = {(s + begin, length, q) for begin, words in zip(begins, texts) for s, length, q in brute_runs(words)}
        found = [tuple(row) for row in diagonals(np.array(flat, np.int64), 24, 3).tolist()]
        assert set(found) == expected and len(found) == len(expected)


def expected_digest(key, text):
    words = [word for word in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if word]
    if key is not None and zlib.crc32(str(key).encode()) % 10 == 0 and words:
        g, n = zlib.crc32(str(key).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda run: (run[1] / run[2], -run[0], -run[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(word for i, word in enumerate(words) if i not in gone)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_registered_query_against_brute_force(spark, tmp_path, make_docs):
    dice = random.Random(8)
    texts = ODD + [" ".join(repetitive(dice)) for _ in range(60)] + ["a b c " * 3000]
    rows = [(n, text) for n, text in enumerate(texts)] + [(None, "a " * 30), (3, "b " * 30), (3, "b " * 30)]
    folder = run_dir(spark, "runs-table")
    clashing(make_docs(rows)).write.parquet(f"{folder}/documents.parquet")
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = [tuple(row[c] for c in columns) for row in QUERIES["op13_periodic_runs"](spark, folder).collect()]
    expected = [expected_digest(*row) for row in rows if row[1] is None or len(row[1]) < 10_000]
    found_short = [row for row in found if row[0] != len(texts) - 1]
    assert sorted(map(str, found_short)) == sorted(map(str, expected))
    if zlib.crc32(str(len(texts) - 1).encode()) % 10:
        (long,) = [row for row in found if row[0] == len(texts) - 1]
        assert long[1:6] == (1, 0, 9000, 3, 3_000_000)


def test_no_documents_no_runs(make_docs):
    assert find_runs(make_docs([]), rewrite=looped).collect() == []


def test_fewer_periods_are_refused(make_docs):
    with pytest.raises(ValueError):
        find_runs(make_docs([]), least_periods=2)
