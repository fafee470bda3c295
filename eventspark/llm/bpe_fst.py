"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The encoding of every prefix of a piece is unique, and a sequence of tokens is an encoding exactly when each two
neighbours are left as they are by the merges. A state of the transducer therefore holds the bytes that a token may still
span and, for each place in them a token may start at, the last token before it. Reading a byte leads to the next state
and tells the token that ends there, which also tells the place it starts at. Tokens before the point that the paths to
all open places share are settled and emitted: the lookahead is bounded by the bytes a token can span. States are numbered
when first reached, and transitions are kept as they are found, up to a bound; beyond it the tables start anew, which
costs time but never changes an output.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.session import ready

MAX_STATES, MAX_PIECES, MAX_PAIRS = 300_000, 400_000, 700_000
#: Bytes of a piece after which settled tokens are emitted; more than twice the longest token.
SETTLE = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """``encode(bytes) -> ids`` of one piece; every single byte has to be a token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.starts = {token[:n] for token in ranks for n in range(len(token) + 1)}
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: bytes a token may still span, and for each place in and after them the last token before it
        self.states: list[tuple[bytes, tuple[int | None, ...]]] = [(b"", (-1,))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Tokens by the definition: the adjacent pair of least rank, leftmost first, is merged until none is left."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token`` is left as it is after ``before`` (-1: at the start)."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.token[token]) == [token]
        if before < 0 or not known:
            return known
        pair = before << 32 | token
        fits = self.pairs.get(pair)
        if fits is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            fits = self.pairs[pair] = self.merged(self.token[before] + self.token[token]) == [before, token]
        return fits

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        window, before = self.states[state]
        window += bytes([byte])
        ranks, starts = self.ranks, self.starts
        for i, last in enumerate(before):
            if last is not None:
                token = ranks.get(window[i:])
                if token is not None and self._fits(last, token):
                    break
        cut = 0
        while window[cut:] not in starts:
            cut += 1
        # no token reaches beyond the end from a place whose bytes start none
        kept = [x if x is not None and window[i:] in starts else None for i, x in enumerate(before[cut:], cut)]
        key = (window[cut:], (*kept, token))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        found = self.moves[state << 8 | byte] = (to, token)
        return found

    def _back(self, tokens: list[int], place: int) -> list[int]:
        """The tokens on the path to ``place``, last first; ``tokens[i]`` ends after byte i."""
        path = []
        while place:
            path.append(tokens[place - 1])
            place -= self.size[path[-1]]
        return path

    def encode(self, data: bytes) -> list[int]:
        out: list[int] = []
        ends: list[int] = []
        state, moves = 0, self.moves
        for byte in data:
            state, token = moves.get(state << 8 | byte) or self._move(state, byte)
            ends.append(token)
            if len(ends) >= SETTLE:
                state = self._settle(state, ends, out)
                moves = self.moves
        out += reversed(self._back(ends, len(ends)))
        if len(self.states) > MAX_STATES:
            self._reset()
        return out

    def _settle(self, state: int, ends: list[int], out: list[int]) -> int:
        """Emit what the paths to all open places share, and forget the bytes before."""
        before = self.states[state][1]
        places = [len(ends) + 1 - len(before) + i for i, x in enumerate(before) if x is not None]
        paths = [self._back(ends, p)[::-1] for p in places]
        same = 0
        while all(len(p) > same for p in paths) and len({p[same] for p in paths}) == 1:
            same += 1
        shared = paths[0][:same]
        out += shared
        del ends[: sum(self.size[t] for t in shared)]
        if len(self.states) > MAX_STATES:
            key = self.states[state]
            self._reset()
            if key not in self.number:
                self.number[key] = len(self.states)
                self.states.append(key)
            state = self.number[key]
        return state


class Codec:
    """Splits text by a pattern, encodes each match on its own, and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.fst = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        matches = self.split(text)
        if len(pieces) > MAX_PIECES:
            pieces.clear()
        for piece in set(matches).difference(pieces):
            ids = self.fst.encode(piece.encode())
            pieces[piece] = np.array(ids, dtype="<u4").tobytes()
        return np.frombuffer(b"".join([pieces[p] for p in matches]), dtype="<u4")

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        token = self.fst.token
        return b"".join([token[i] for i in ids])

    def decode_stream(self, ids: Iterable[int], every: int = 256) -> Iterator[str]:
        """Text after each ``every`` tokens: bytes of an unfinished character wait in the decoder's state for the next ones."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids = iter(ids)
        while some := list(islice(ids, every)):
            yield machine.decode(self.decode_bytes(some))
        if rest := machine.decode(b"", True):
            yield rest


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with ``into``: the ids of the whole text, as binary of little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Every text's length is allowed; rows keep all other columns, and a
    column already named ``into`` is replaced. An empty table gives an empty table.
    """

    @F.pandas_udf("binary")
    def run(texts):
        c = codec(path, pattern)
        return texts.map(lambda t: c.encode(t or "").tobytes())

    ready(df.sparkSession)
    return df.withColumn(into, run(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with ``into``: the text of packed ids (as ``encode`` makes them), decoded as a stream.

    Null ids give an empty text; ids that are no complete UTF-8 give replacement characters.
    """

    @F.pandas_udf("string")
    def run(packed):
        c = codec(path, pattern)
        return packed.map(lambda b: "".join(c.decode_stream(np.frombuffer(b, "<u4").tolist())))

    ready(df.sparkSession)
    return df.withColumn(into, run(F.coalesce(ids, F.lit(b""))))


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; encodes, and decodes what it has encoded.

    Nulls in ``text`` count as empty, ``doc_id`` may be null or repeated, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256("".join(c.decode_stream(ids.tolist())).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ready(df.sparkSession)
    texts = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
