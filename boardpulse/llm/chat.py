"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: per turn ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside
roles and texts every ``<|`` becomes ``<|\\\\`` and every ``<|\\\\`` ... one backslash more, so
a control string can only be a turn mark and the text comes back exactly. The rendered
text is encoded once with character offsets; the sorted spans of the assistant's texts are
met with the sorted token spans by binary search, and a token is under the loss if its
span touches one of them.

Turns are rendered and encoded where the turns of a conversation meet; a conversation is
one training example and has to fit a task, but the conversations of a table are spread
by their id, and rows are only grouped, never sorted as a whole. Rows with a null
conversation id belong to no conversation; each is rendered as one of its own.

Defined results: a null text or role is empty; rows are ordered by turn, null turns first,
ties by role and text; repeated rows are repeated turns; an empty table gives no rows;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.llm.segments import tokenizer_path
from boardpulse.llm.shared import encode_frame, in_arrow

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"<\|")
FORMATTED = (
    "conv_id long, formatted string, spans array<struct<begin:int,end:int>>, "
    "input_ids array<int>, token_begins array<int>, token_ends array<int>, loss_mask array<boolean>"
)


def escape(text: str | None) -> str:
    """Every ``<|`` gets a backslash after it; control strings no longer occur."""
    return _ESCAPE.sub(r"<|\\", text or "")


def unescape(text: str) -> str:
    return text.replace("<|\\", "<|")


def render(turns: list[tuple[str | None, str | None]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans of the trained role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        name, body = escape(role).replace("\n", "<|n"), escape(text)
        head = f"{START}{name}\n"
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END + "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        stop = formatted.index(END, at)
        role, _, text = formatted[at + len(START) : stop].partition("\n")
        turns.append((unescape(role.replace("<|n", "\n")), unescape(text)))
        at = stop + len(END) + 1
    return turns


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens touch a span; both are sorted, each span's tokens come from two binary searches."""
    mask = np.zeros(len(offsets), bool)
    if not len(offsets):
        return mask
    begins, ends = offsets[:, 0], offsets[:, 1]
    for begin, end in spans:
        first = np.searchsorted(ends, begin, "right")
        last = np.searchsorted(begins, end, "left")
        mask[first:last] = True
    return mask & (ends > begins)


_tokenizers: dict[str, object] = {}


def _tokenizer(name: str):  # noqa: ANN202
    if name not in _tokenizers:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path(name))
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _tokenizers[name] = tokenizer
    return _tokenizers[name]


def format_chats(
    rows: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    trained: str = "assistant",
    columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"),
) -> DataFrame:
    """One row per conversation: text, spans of the trained texts in code points, ids and token mask."""
    conv, turn, role, text = columns
    named = rows.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("entry"),
    )
    whole = named.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("entry")).alias("turns"))
    single = named.where("conv_id IS NULL").select("conv_id", F.array("entry").alias("turns"))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer)
        for batch in batches:
            out: dict[str, list] = {"formatted": [], "spans": [], "input_ids": [], "token_begins": [], "token_ends": [], "loss_mask": []}
            for turns in batch.column(1).to_pylist():
                formatted, spans = render([(t["role"], t["text"]) for t in turns], trained)
                found = encode.encode(formatted, add_special_tokens=False)
                offsets = np.array(found.offsets, np.int32).reshape(-1, 2)
                out["formatted"].append(formatted)
                out["spans"].append([{"begin": b, "end": e} for b, e in spans])
                out["input_ids"].append(found.ids)
                out["token_begins"].append(offsets[:, 0])
                out["token_ends"].append(offsets[:, 1])
                out["loss_mask"].append(token_mask(offsets, spans))
            span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
            kinds = {"formatted": pa.string(), "spans": pa.list_(span), "loss_mask": pa.list_(pa.bool_())}
            arrays = {n: pa.array(v, kinds.get(n, pa.list_(pa.int32()))) for n, v in out.items()}
            yield encode_frame({"conv_id": batch.column(0)} | arrays)

    return in_arrow(whole.unionByName(single), form, FORMATTED)


def masked_text(formatted: str, spans: np.ndarray, begins: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The characters of masked tokens that lie in the spans, unescaped span by span."""
    under = np.zeros(len(formatted) + 1, np.int32)
    np.add.at(under, begins[mask], 1)
    np.add.at(under, ends[mask], -1)
    covered = np.cumsum(under) > 0
    parts = []
    for begin, end in spans:
        kept = np.flatnonzero(covered[begin:end]) + begin
        parts.append(unescape("".join(formatted[k] for k in kept) if len(kept) < end - begin else formatted[begin:end]))
    return "".join(parts)


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the output: turns, and the text under the loss mask, unescaped."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                spans = [(s["begin"], s["end"]) for s in batch.column(2)[row].as_py()]
                begins, ends, mask = (batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in (3, 4, 5))
                turns, loss = parse(text), masked_text(text, spans, begins, ends, mask)
                joined = "".join(f"{role}\n{body}\n" for role, body in turns)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            kinds = {"turns_sha256": pa.string(), "loss_sha256": pa.string()}
            yield encode_frame({"conv_id": batch.column(0)} | {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_arrow(formatted.select("conv_id", "formatted", "spans", "token_begins", "token_ends", "loss_mask"), read, schema)
