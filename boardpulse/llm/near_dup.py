"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is its lower-cased words; its k-mers are the runs of five words (all words of a
shorter text), each labelled with the number of its occurrence, so that a repeated run
counts as often as it is repeated. Similarity of two texts is that of their k-mer
sequences aligned in order: common / (n + m - common), ``common`` the longest common
subsequence. Without moved passages it equals the Jaccard similarity of the labelled
k-mers. Texts at 0.8 or more are linked, classes are the connected components.

1. Texts with the same words are one node from the start, whatever their number.
2. Order MinHash: each of ``TABLES`` hash functions samples the ``DEPTH`` k-mers with the
   smallest values and keeps them in the order of the text; nodes with equal samples of a
   function share a bucket. At similarity 0.8 a pair of long texts misses all buckets about
   once in 3,000; at 0.5 it shares each with a chance of 3 %. Texts of at most ``SHORT``
   k-mers take an exact way instead: ordered from rare to common, the first
   n - ceil(0.8 n) + 1 k-mers of both texts of a linked pair have one in common, so each of
   these is a bucket, also for texts that are too long but can be near a short one.
3. In every bucket the members are compared with the first one. Buckets that are one class
   then are done, with work linear in their size. In the others every two members of
   different classes are compared: the members are dealt into blocks of ``GROUP``, every
   pair of blocks is one piece of work for any task, and in it the numbers of common
   k-mers come from one sparse product. No member is left out and no bucket has a cap.
4. Candidates with enough common k-mers are verified exactly: those within the band that
   the threshold allows are chained in order. For this step words are kept as the lower
   half of their 32-bit codes, so a changed word passes as unchanged once in 65,536.

Defined results: null and empty texts, and texts without words, are copies of each other
if they are equal as strings, and near nothing else; a null id is kept in its class but is
never its name unless all ids are null; repeated rows are copies; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardpulse.llm.components import components
from boardpulse.llm.shared import encode_frame, in_arrow, slices, stored, whole_groups

K, TABLES, DEPTH = 5, 20, 5
THRESHOLD = 0.8
SHORT = 30
NEAR_SHORT = int(SHORT / THRESHOLD)  # no longer text is near a short one
GROUP = 128
MOST_WORDS = 600_000
_WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SIGNED = "words_key binary, doc_id long, n long, codes binary, buckets array<long>, runs array<long>"


class _Codes(dict):
    """Word to a 32-bit code, as words are met."""

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        code = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return code


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX
    return values ^ (values >> np.uint64(31))


def word_codes(text: str | None, codes: _Codes) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the runs of ``k`` words in text order, labelled with their occurrence."""
    k = min(k, len(codes))
    if not k:
        return np.zeros(0, np.uint64)
    wide, count = codes.astype(np.uint64), len(codes) - k + 1
    out = np.full(count, k, np.uint64)
    for place in range(k):
        out = out * _ODD[0] + wide[place : place + count] * _ODD[1]
    out = _mixed(out)
    order = np.argsort(out, kind="stable")
    same = np.concatenate([[False], np.diff(out[order]) == 0])
    if same.any():
        at = np.arange(count)
        nth = at - np.maximum.accumulate(np.where(same, 0, at))
        label = np.zeros(count, np.uint64)
        label[order] = nth.astype(np.uint64)
        out = np.where(label > 0, _mixed(out + label * _ODD[2]), out)
    return out


def order_minhash(values: np.ndarray, sizes: np.ndarray, tables: int = TABLES, depth: int = DEPTH) -> np.ndarray:
    """Per text (runs of ``sizes`` k-mers, none empty) one bucket per table.

    A threshold of about six times ``depth`` expected values prunes each text first; a text
    in which fewer than ``depth`` values pass is looked through whole.
    """
    texts = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    share = np.minimum(1.0, 6.0 * depth / sizes)
    limits = np.repeat((share * float(2**63)).astype(np.uint64), sizes)
    limits[np.repeat(share, sizes) >= 1] = np.uint64(2**64 - 1)
    wanted = np.minimum(depth, sizes)
    out = np.empty((len(sizes), tables), np.uint64)
    for table in range(tables):
        seed = _mixed(np.array([table + 1], np.uint64) * _ODD[3])[0]
        ranked = _mixed(values ^ seed)
        passing = np.flatnonzero((ranked >> np.uint64(1)) <= limits)
        counts = np.bincount(texts[passing], minlength=len(sizes))
        for text in np.flatnonzero(counts < wanted).tolist():
            whole = np.arange(starts[text], starts[text] + sizes[text])
            passing = np.concatenate([passing[texts[passing] != text], whole])
        if (counts < wanted).any():
            passing = np.sort(passing)
            counts = np.bincount(texts[passing], minlength=len(sizes))
        order = np.lexsort((ranked[passing], texts[passing]))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        chosen = np.sort(passing[order][rank < np.repeat(wanted, counts)])  # text order again
        first = np.cumsum(wanted) - wanted
        place = np.arange(len(chosen)) - np.repeat(first, wanted)
        out[:, table] = _mixed(np.add.reduceat(values[chosen] * _ODD[place % 5], first) + np.uint64(table))
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, order: np.ndarray | None = None) -> bool:
    """Whether the labelled k-mer sequences ``a`` and ``b`` align to ``threshold`` or more.

    ``order`` sorts ``a``. Only matches within the band of shifts that an alignment at the
    threshold can have are chained.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    need = threshold * (n + m) / (1 + threshold) - 1e-9
    if min(n, m) < need:
        return False
    order = np.argsort(a, kind="stable") if order is None else order
    at = np.searchsorted(a, b, sorter=order)
    at[at == n] = 0
    places = order[at]
    hit = np.flatnonzero(a[places] == b)
    band = n + m - 2 * need
    hit = hit[np.abs(places[hit] - hit) <= band]
    if len(hit) < need:
        return False
    chain = places[hit]
    if (np.diff(chain) > 0).all():
        return True
    tails: list[int] = []
    for place in chain.tolist():
        slot = bisect_left(tails, place)
        tails[slot : slot + 1] = [place]
    return len(tails) >= need


def signed_texts(docs: DataFrame, id_column: str, text_column: str, prints: bool = False) -> DataFrame:
    """Per row: key of its words, id, number of k-mers, word codes, buckets (long texts) and k-mers (short texts)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                texts = batch.column(1).to_pylist()
                coded = [word_codes(text, codes) for text in texts]
                runs = [kmers(c) for c in coded]
                sizes = np.array([len(r) for r in runs], np.int64)
                full = np.flatnonzero(sizes > SHORT)
                buckets: list = [[]] * len(texts)
                if len(full):
                    found = order_minhash(np.concatenate([runs[i] for i in full]), sizes[full]).view(np.int64)
                    for place, row in zip(full.tolist(), found):
                        buckets[place] = row
                keys = [
                    hashlib.blake2b(c.tobytes() if len(c) else b"=" + (t or "").encode("utf-8", "replace"), digest_size=16, person=b"words" if len(c) else b"text").digest()
                    for c, t in zip(coded, texts)
                ]
                hashes = {name: batch.column(2 + k) for k, name in enumerate(("p1", "p2") if prints else ())}
                yield encode_frame(
                    {
                        "words_key": pa.array(keys, pa.binary()),
                        "doc_id": batch.column(0),
                        "n": pa.array(sizes),
                        "codes": pa.array([c.astype("<u2").tobytes() for c in coded], pa.binary()),
                        "buckets": pa.array(buckets, pa.list_(pa.int64())),
                        "runs": pa.array([r.view(np.int64) if len(r) <= NEAR_SHORT else [] for r in runs], pa.list_(pa.int64())),
                        **hashes,
                    }
                )

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    if prints:
        first, second = _prints(F.col("text"))
        return in_arrow(rows.select("id", "text", first, second), sign, _SIGNED + ", p1 long, p2 long")
    return in_arrow(rows, sign, _SIGNED)


def _short_buckets(firsts: DataFrame) -> DataFrame:
    """Buckets (node, n, bucket) of the rarest k-mers of short texts; k-mers of a single text make none."""
    runs = stored(firsts.where(F.size("runs") > 0).select("node", "n", F.explode("runs").alias("run")), "runs")
    times = runs.groupBy("run").agg(F.count(F.lit(1)).alias("times"))
    rarest = Window.partitionBy("node").orderBy("times", "run")
    needed = F.col("n") - F.ceil(F.col("n") * THRESHOLD - 1e-9) + 1
    first = runs.join(times.hint("merge"), "run").withColumn("rank", F.row_number().over(rarest)).where((F.col("rank") <= needed) & (F.col("times") > 1))
    return first.select("node", "n", F.xxhash64(F.lit("short"), "run").alias("bucket"))


def common_counts(runs: list[np.ndarray]) -> np.ndarray:
    """Number of common labelled k-mers of every two texts."""
    sizes = np.array([len(r) for r in runs])
    total = np.zeros((len(runs), len(runs)), np.float32)
    _, places, times = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
    texts = np.repeat(np.arange(len(runs)), sizes)
    shared = times[places] > 1
    texts, places = texts[shared], places[shared]
    kept = np.cumsum(times > 1) - 1
    places = kept[places]
    wide = int(kept[-1]) + 1 if len(kept) else 0
    for begin in range(0, wide, 8192):
        here = (places >= begin) & (places < begin + 8192)
        block = np.zeros((len(runs), min(8192, wide - begin)), np.float32)
        block[texts[here], places[here] - begin] = 1
        total += block @ block.T
    return total


def _joining(pairs: list[list[int]], labels: list[int], test: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs that pass ``test`` and join classes not joined by the pairs before."""
    root = {label: label for label in labels}

    def find(label: int) -> int:
        while root[label] != label:
            root[label] = label = root[root[label]]
        return label

    out = []
    for x, y in pairs:
        mine, other = find(labels[x]), find(labels[y])
        if mine != other and test(x, y):
            root[mine] = other
            out.append((x, y))
    return out


def _within_buckets(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) that links within a bucket join; rows hold bucket, node, label and size."""
    n_blocks = F.ceil(F.col("size") / GROUP).cast("int")
    placed = rows.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), n_blocks).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    pairs = pairs.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "label", "block")
    filled = pairs.join(codes.hint("merge"), "node").select("bucket", "low", "high", "node", "label", "block", "codes")
    grouped = filled.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 3):
            labels, blocks = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            differ = labels[:, None] != labels[None, :]
            if batch.column(1)[0] != batch.column(2)[0]:
                differ &= blocks[:, None] != blocks[None, :]
            linked: list[tuple[int, int]] = []
            if differ.any():
                runs = [kmers(np.frombuffer(c, "<u2")) for c in batch.column(6).to_pylist()]
                sizes = np.array([len(r) for r in runs], np.float64)
                need = THRESHOLD * (sizes[:, None] + sizes[None, :]) / (1 + THRESHOLD) - 1e-6
                likely = np.triu(differ & (common_counts(runs) >= need), 1)
                linked = _joining(np.argwhere(likely).tolist(), labels.tolist(), lambda x, y: aligned(runs[x], runs[y]))
            a, b = labels[[x for x, _ in linked]], labels[[y for _, y in linked]]
            yield encode_frame({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return in_arrow(grouped, compare, "a long, b long")


def _verified(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Which pairs (a, b) align; a is the member many others are compared with."""
    left = pairs.join(codes.select(F.col("node").alias("b"), F.col("codes").alias("b_codes")).hint("merge"), "b")
    both = left.join(codes.select(F.col("node").alias("a"), F.col("codes").alias("a_codes")).hint("merge"), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, order = None, None, None
        for batch in batches:
            linked = []
            for a, code_a, code_b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if a != last:
                    last, run = a, kmers(np.frombuffer(code_a, "<u2"))
                    order = np.argsort(run, kind="stable")
                linked.append(aligned(run, kmers(np.frombuffer(code_b, "<u2")), order=order))
            yield encode_frame({"a": batch.column(0), "b": batch.column(1), "linked": pa.array(linked, pa.bool_())})

    return in_arrow(both.select("a", "b", "a_codes", "b_codes"), check, "a long, b long, linked boolean")


def _classified(signed: DataFrame) -> DataFrame:
    """Key of the words and smallest id of the class (label) for every node of ``signed``."""
    # What grows with the corpus is joined by shuffling at every size, never broadcast because it
    # happens to be small still: hence the merge hints.
    # One node per distinct sequence of words, named by its first row.
    nodes = stored(signed.groupBy("words_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("low_id")), "nodes")

    firsts = signed.select(F.col("row").alias("node"), "n", "buckets", "runs").join(nodes.select("node").hint("merge"), "node")
    spread = firsts.select("node", "n", F.explode("buckets").alias("bucket"))
    spread = stored(spread.unionByName(_short_buckets(firsts)), "spread")
    shared = stored(
        spread.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"), "shared"
    )
    members = stored(spread.join(shared.hint("merge"), "bucket"), "members")

    def fits(a: str, b: str) -> Column:  # lengths alone rule out a similarity of 0.8
        return F.least(a, b) >= THRESHOLD * F.greatest(a, b)

    heads = members.where("node = first").select("bucket", F.col("n").alias("a_n"))
    pairs = members.where("node != first").join(heads.hint("merge"), "bucket").where(fits("a_n", "n"))
    pairs = stored(pairs.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    # Word codes of all nodes that meet another in a bucket.
    meeting = stored(members.select("node").distinct(), "meeting")
    codes = stored(signed.select(F.col("row").alias("node"), "codes").join(meeting.hint("merge"), "node"), "codes")

    links = stored(_verified(pairs, codes).where("linked").select("a", "b"), "links")
    labels = components(links)
    # Buckets that still hold several classes; all members of a pair's bucket were compared with its first.
    labelled = members.where("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled, "labelled")
    spans = labelled.groupBy("bucket").agg(F.min("label").alias("lowest"), F.max("label").alias("highest"))
    mixed = stored(spans.where("lowest != highest").select("bucket"), "mixed")
    more = stored(_within_buckets(labelled.join(mixed, "bucket"), codes).distinct(), "links")
    roots = components(more).select(F.col("node").alias("label"), F.col("label").alias("root"))

    classes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = stored(classes.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root"), "classes")
    names = stored(classes.groupBy("label").agg(F.min("low_id").alias("class_id")), "names")
    return stored(classes.join(names, "label").select("words_key", "class_id", "label"), "of-key")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, class_id (smallest id of the class), kept (it names the class)."""
    signed = stored(signed_texts(docs, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "signed")
    out = signed.select("words_key", F.col("doc_id")).join(_classified(signed).drop("label"), "words_key")
    return out.select(F.col("doc_id").alias(id_column), "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def _prints(text: Column) -> list[Column]:
    """Two hashes of a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` for every class, with all its columns.

    The row has the smallest id of the class, null only if all are null; ids that rows of
    different classes share, null included, do not make them copies.
    """
    signed = signed_texts(docs, id_column, text_column, prints=True).withColumn("row", F.monotonically_increasing_id())
    signed = stored(signed, "signed")
    classed = signed.select("words_key", "doc_id", "p1", "p2").join(_classified(signed).select("words_key", "label"), "words_key")
    # Ids first, nulls last; of several texts with the id, one by its hashes.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("p1"), F.col("p2"))).alias("best")
    rows = stored(classed.groupBy("label").agg(best).select("best.doc_id", "best.p1", "best.p2"), "keepers")
    keepers = rows.select(F.col("doc_id").alias("kept_id"), F.col("p1").alias("kept_p1"), F.col("p2").alias("kept_p2"))

    def same(frame: DataFrame, other: DataFrame) -> Column:
        first, second = _prints(frame[text_column].cast("string"))
        return (first == other["kept_p1"]) & (second == other["kept_p2"]) & frame[id_column].cast("long").eqNullSafe(other["kept_id"])

    kept = docs.join(keepers, same(docs, keepers), "left_semi")
    again = signed.groupBy(F.col("doc_id").alias("kept_id"), F.col("p1").alias("kept_p1"), F.col("p2").alias("kept_p2")).count()
    again = stored(again.where("count > 1").drop("count"), "again")
    if again.isEmpty():
        return kept
    # Rows that are equal in id and text: one of them stays.
    single = kept.join(again, same(kept, again), "left_anti")
    several = kept.join(again, same(kept, again), "left_semi").dropDuplicates([id_column, text_column])
    return single.unionByName(several)
