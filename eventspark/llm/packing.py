"""Packing tokenised documents into sequences of a fixed length by best-two-fit.

Documents of one length are interchangeable, so the packing is planned on the histogram of lengths (at most ``capacity``
rows, however many documents there are): a bin is filled greedily with the longest pieces that fit; then its smallest
piece gives way to the two unpacked pieces that fill the gap it leaves best. A plan entry holds for as many bins as there
are pieces for it. Every piece then finds its place from its rank among the pieces of its length; ranks come from counts
per task, so no task sees all pieces of a length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.llm.session import ready, stored

MAX_WORDS, MAX_PIECES = 800_000, 400_000
#: White space beyond space, tab and line ends, on which engines differ; texts with it are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ENCODERS: dict[str, WordEncoder] = {}


def _byte_letters() -> list[str]:
    """The character a byte-level vocabulary writes for each byte: itself if visible in Latin-1, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts for a lower-casing tokenizer that drops white space and never joins words across it.

    The ids of a text are those of its words one after another, and those of a word those of the pieces its pattern cuts it
    into. Words and pieces are encoded once, as long as the bounded memory of this process holds them; the library's own model
    encodes a piece. Words with letters beyond Latin (where normalisation may matter) or special tokens, and texts with unusual
    white space, go through the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(written)], dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word or "\u0130" in word or not (word.isascii() or max(word) < "\u0250"):
            return self._whole(word)
        pieces = self.pieces
        out = []
        for piece in self.split(word.lower()):
            ids = pieces.get(piece)
            if ids is None:
                if len(pieces) >= MAX_PIECES:
                    pieces.clear()
                ids = pieces[piece] = self._piece(piece)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if _ODD_SPACE.search(text):
            return self._whole(text)
        words, known = text.split(), self.words
        if len(known) > MAX_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self._word(word)
        return b"".join([known[w] for w in words])


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Give up what this process holds of words and pieces; called by name, as a task's function has copies of globals."""
    _ENCODERS.clear()


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, each document closed by the id ``end``.

    Rows: ``doc_id, piece, start, length, ids_crc32``, and ``task, nth``: the piece is the nth of its length in its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), Counter()
        enc, tail = encoder(path), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = enc.encode(text or "") + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            columns = zip(*rows, strict=True) if rows else [()] * 7
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return texts.mapInArrow(run, schema)


def best_two_fit(histogram: Mapping[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Per length: rows ``(first rank, first bin, pieces of that length in a bin, offset)``, by first rank."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    out: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
    first_bin = 0
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            break
        gap, take = capacity, {}
        at = len(have) - 1
        while at >= 0:
            n = int(have[at])
            k = min(int(left[n]), gap // n)
            if k:
                take[n] = k
                gap -= k * n
            at = min(at - 1, int(np.searchsorted(have, gap, "right")) - 1)
        if gap:
            least = min(take)
            room = gap + least
            rest = left[have] - [take.get(int(n), 0) for n in have]
            open_, counts = have[rest > 0], rest[rest > 0]
            other = np.searchsorted(open_, room - open_, "right") - 1
            mine = np.arange(len(open_))
            fits = (other > mine) | ((other == mine) & (counts > 1))
            both = np.where(fits, open_ + open_[other], 0)
            if len(both) and both.max() > least:
                i = int(both.argmax())
                take[least] -= 1
                for n in (int(open_[i]), int(open_[other[i]])):
                    take[n] = take.get(n, 0) + 1
                take = {n: k for n, k in take.items() if k}
        bins = min(int(left[n]) // k for n, k in take.items())
        offset = 0
        for n, k in take.items():
            out[n].append((int(used[n]), first_bin, k, offset))
            offset += k * n
            used[n] += bins * k
            left[n] -= bins * k
        first_bin += bins
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """``docs (doc_id, text, ..)`` -> ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Only documents longer than ``capacity`` are cut. A null or empty text has one piece, the end id alone. ``doc_id`` may be
    null or repeated; other columns are ignored. An empty table gives no rows.
    """
    made = stored(pieces(docs, path, capacity, end))
    per_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_two_fit(histogram, capacity)
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    skip = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    ranked = made.join(skip, ["length", "task"]).withColumn("rank", F.col("skip") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # all pieces are stored by now
        forget()
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                entry = plan[int(n)]
                first, bin_, k, start = entry[np.searchsorted(entry[:, 0], rank[rows], "right") - 1].T
                nth = rank[rows] - first
                sequence[rows] = bin_ + nth // k
                offset[rows] = start + nth % k * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)],
                [*columns, "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(place, schema)
