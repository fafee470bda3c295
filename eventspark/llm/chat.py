"""Conversations as marked-up training texts with a loss mask aligned to tokens by offsets.

A conversation is rendered whole; the spans of its turns are sorted as they are made. It is encoded once, with the span of
every token, and the mask of a token comes from a binary search of its span among the turn spans. The markers are tokens of
their own, and texts hold none: a backslash is put after the first character of any marker in a text and before any
backslash, which is undone when read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.session import ready

BEGIN, CLOSE = "<s>", "</s>"
OPENERS = {"user": "[INST]", "system": "[SYS]", "assistant": "[OUT]"}
CLOSERS = {"user": "[/INST]", "system": "[/SYS]", "assistant": CLOSE}
OTHER, NAME_END, OTHER_END = "[ROLE]", "[NAME]", "[/ROLE]"
MARKERS = [BEGIN, CLOSE, "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", OTHER, NAME_END, OTHER_END]
_UNSAFE = re.compile("|".join([r"\\", *map(re.escape, MARKERS)]))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile("|".join(map(re.escape, [*OPENERS.values(), OTHER])))
#: Conversations a task holds decoded at a time.
FEW = 64
_TOKENIZERS: dict = {}


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the assistants' (escaped) texts in it."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        head = OPENERS[role] if role in OPENERS else OTHER + escape(role) + NAME_END
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSERS.get(role, OTHER_END)]
        at += sum(map(len, parts[-3:]))
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    roles = {v: k for k, v in OPENERS.items()}
    at, turns = len(BEGIN), []
    while m := _TURN.match(formatted, at):
        at, role = m.end(), roles.get(m[0])
        if role is None:
            end = formatted.index(NAME_END, at)
            role, at = unescape(formatted[at:end]), end + len(NAME_END)
        close = CLOSERS.get(role, OTHER_END) if m[0] != OTHER else OTHER_END
        end = formatted.index(close, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(close)
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token span overlaps one of the sorted turn spans."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    starts, ends = np.array(spans).T
    nth = np.searchsorted(ends, offsets[:, 0], "right")
    inside = np.minimum(nth, len(starts) - 1)
    return (nth < len(starts)) & (starts[inside] < offsets[:, 1])


def masked_spans(offsets: np.ndarray, on: np.ndarray) -> list[tuple[int, int]]:
    """Runs of masked tokens as spans; tokens that share a character have overlapping spans."""
    out: list[list[int]] = []
    for a, b in offsets[on].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = False
        made.add_special_tokens([AddedToken(m, normalized=False) for m in MARKERS])
        made.no_truncation()
        _TOKENIZERS[path] = made
    return _TOKENIZERS[path]


def format_conversations(turns: DataFrame, path: str) -> DataFrame:
    """``turns (conv_id, turn, role, text, ..)`` -> ``conv_id, formatted, ids, loss`` (a mask value per id).

    One row per conversation, its turns by ``turn`` (nulls first; ties by role and text, repeated rows each). A null role or
    text counts as empty; each row with a null conv_id is a conversation of its own. A row holds a whole conversation, so its
    size is that of the longest. Other columns are ignored. An empty table gives no rows.
    """
    spark = ready(turns.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    conv = F.col("conv_id").cast("long")
    own = F.when(conv.isNull(), F.monotonically_increasing_id())
    rows = turns.select(conv.alias("conv_id"), own.alias("own"), turn.alias("turn"))
    whole = rows.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_batch
        for batch in batches:
            for part in (batch.slice(k, FEW) for k in range(0, batch.num_rows, FEW)):
                made = [render([tuple(t.values()) for t in turns]) for turns in part.column("turns").to_pylist()]
                ids, loss = [], []
                for (_, spans), e in zip(made, encode([m[0] for m in made], add_special_tokens=False), strict=True):
                    ids.append(np.array(e.ids, dtype=np.int32))
                    loss.append(mask(np.array(e.offsets, dtype=np.int64).reshape(-1, 2), spans))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("conv_id"),
                        pa.array([m[0] for m in made], pa.string()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(loss, pa.list_(pa.bool_())),
                    ],
                    ["conv_id", "formatted", "ids", "loss"],
                )

    return whole.mapInArrow(run, "conv_id long, formatted string, ids array<int>, loss array<boolean>")


def digests(formatted: DataFrame, path: str) -> DataFrame:
    """What a reader of the output finds: turns parsed from the text, and the text under the loss mask, found by decoding the
    masked ids and undoing the escapes."""
    spark = ready(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in (b.slice(k, FEW) for b in batches for k in range(0, b.num_rows, FEW)):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "ids", "loss"))
            for conv, text, ids, loss in zip(*columns, strict=True):
                turns = parse(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                on = unescape(tok.decode([i for i, m in zip(ids, loss, strict=True) if m], skip_special_tokens=False))
                rows.append((conv, len(turns), said, len(on), hashlib.sha256(on.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(run, schema)
