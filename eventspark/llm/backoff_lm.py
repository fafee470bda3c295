"""Scoring texts with a weighted backoff automaton of smoothed n-grams learnt from all training documents.

The model: P(w) = (c(w) + 1) / (N + V + 1), one share being left for unknown words, and after a word h
P(w | h) = (c(h w) + m P(w)) / (c(h) + m). As an automaton, a word (or the start) is a state; a seen bigram is an arc from
h with weight log P(w | h); a failure arc leads from h to the empty state with weight log(m / (c(h) + m)), from which every
word has an arc. Both sum to one over the words, the end and the unknown. n-grams are of one and two words.

No task holds the whole model. Documents are dealt into chunks of bounded size. A chunk sends the n-grams it meets, with its
own training counts, to the shards that n-grams hash to; a shard adds them up and returns to each chunk what others have
counted. With these totals a chunk compiles the part of the automaton that its texts can reach (:class:`Automaton`) and walks
them from left to right, many texts abreast: every text carries its state, follows failure arcs until an arc for the next word
is found, and adds up the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.session import ready, stored
from eventspark.llm.words import mix, windows, word_hashes

#: Bytes of text in a chunk, on average.
CHUNK = 10_000_000
PRIOR = 32.0
#: Words of a text that are walked in one piece.
PIECE = 256
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)


def _planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, which the shuffle compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(blob, np.uint64), dtype=np.uint64)


class Chunk:
    """Tokens of a chunk's documents, and its distinct words and bigrams with their training counts here."""

    def __init__(self, texts: list[bytes], learns: np.ndarray) -> None:
        tokens, self.n_tokens = [], np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            words = word_hashes(text)
            tokens += [words, np.array([END])]
            self.n_tokens[i] = len(words) + 1
        word = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        before = np.roll(word, 1)
        before[self.first] = START
        pairs = windows(np.stack([before, word], axis=1).ravel(), 2)[::2] if len(word) else word
        learning = np.repeat(learns, self.n_tokens)
        self.keys, self.at, self.own, self.seen_at = [], [], [], []
        for x in (word, pairs):
            keys, seen_at, at = np.unique(x, return_index=True, return_inverse=True)
            self.seen_at.append(seen_at)
            self.keys.append(keys)
            self.at.append(at)
            self.own.append(np.bincount(at[learning], minlength=len(keys)).astype(np.uint32))
        self.starts = int(learns.sum())


class Automaton:
    """The states, arcs and failure arcs that the texts of a chunk can reach.

    State 0 is the empty one, state 1 + i belongs to word i, the last is the start. Arcs are sorted by state and word; the arcs
    of the empty state are one array over the words. ``fails_to`` and ``fail_weight`` hold a failure arc for every other state.
    After a word the walk is in that word's state.
    """

    def __init__(self, chunk: Chunk, words: np.ndarray, pairs: np.ndarray, n: int, v: int, starts: int, prior: float) -> None:
        self.n_words = len(words)
        self.start = self.n_words + 1
        self.empty_arcs = np.log10(words + 1.0) - np.log10(float(n + v + 1))
        history = np.concatenate([[0], words, [starts]]).astype(np.float64)
        self.fails_to = np.zeros(len(history), dtype=np.int64)
        self.fail_weight = np.log10(prior) - np.log10(history + prior)
        seen = np.flatnonzero(pairs > 0)
        token = chunk.seen_at[1][seen]
        word = chunk.at[0][token]
        state = np.where(np.isin(token, chunk.first), self.start, chunk.at[0][token - 1] + 1)
        order = np.lexsort((word, state))
        word, state, seen = word[order], state[order], seen[order]
        self.arcs = state * self.n_words + word
        self.arc_weight = np.log10(pairs[seen] + prior * 10.0 ** self.empty_arcs[word]) - np.log10(history[state] + prior)

    def walk(self, words: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Accumulated weight of every text: ``length`` words each, from ``first`` on."""
        # a long text is walked in pieces; a piece starts in the state of the word before it
        pieces = -(-length // PIECE)
        text = np.repeat(np.arange(len(first)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[text] + number * PIECE
        left = np.minimum(length[text] - number * PIECE, PIECE)
        order = np.argsort(-left, kind="stable")
        text, begin, left, number = text[order], begin[order], left[order], number[order]
        state = np.where(number == 0, self.start, words[begin - 1] + 1)
        total = np.zeros(len(text))
        for step in range(int(left[0]) if len(left) else 0):
            going = int(np.searchsorted(-left, -step, side="left"))
            word = words[begin[:going] + step]
            total[:going] += self._next(state[:going], word)
            state[:going] = word + 1
        return np.bincount(text, weights=total, minlength=len(first))

    def _next(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Weight of reading a word in each state, failure arcs included."""
        weight = np.zeros(len(word))
        rows, now = np.arange(len(word)), state
        while len(rows):
            key = now * self.n_words + word[rows]
            at = np.searchsorted(self.arcs, key)
            found = (now > 0) & (at < len(self.arcs))
            found[found] = self.arcs[at[found]] == key[found]
            weight[rows[found]] += self.arc_weight[at[found]]
            ends = now == 0
            weight[rows[ends]] += self.empty_arcs[word[rows[ends]]]
            rows, now = rows[~(found | ends)], now[~(found | ends)]
            weight[rows] += self.fail_weight[now]
            now = self.fails_to[now]
        return weight


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]


def _requests(shards: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(_texts(table), table.column("learns").to_numpy(zero_copy_only=False))
        rows = []
        for kind in (0, 1):
            keys, own = chunk.keys[kind], chunk.own[kind]
            edges = np.arange(1, shards, dtype=np.float64) * (2.0**64 / shards)
            cuts = [0, *np.searchsorted(keys, edges.astype(np.uint64)), len(keys)]
            for shard, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a:
                    rows.append((shard, kind, _pack_keys(keys[a:b]), _planes(own[a:b])))
        number = table.column("chunk")[0].as_py()
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.table(
            {
                "chunk": pa.array([number] * len(rows), pa.int32()),
                "shard": pa.array(columns[0], pa.int32()),
                "kind": pa.array(columns[1], pa.int32()),
                "keys": pa.array(columns[2], pa.binary()),
                "counts": pa.array(columns[3], pa.binary()),
            }
        )

    return run


def _totals(key: tuple, table: pa.Table) -> pa.Table:
    """What each chunk does not know about its n-grams, and (chunk -1) the shard's sums."""
    chunks = table.column("chunk").to_pylist()
    keys = [_unpack_keys(b) for b in table.column("keys").to_pylist()]
    counts = [_unplanes(b, np.uint32) for b in table.column("counts").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    where, more, done = [], [], 0
    for own in counts:
        extra = total[at[done : done + len(own)]] - own
        done += len(own)
        which = np.flatnonzero(extra)
        where.append(_planes(which.astype(np.uint32)))
        more.append(_planes(extra[which].astype(np.uint64)))
    n = len(chunks)
    shard, kind = (x.as_py() for x in key)
    return pa.table(
        {
            "chunk": pa.array([*chunks, -1], pa.int32()),
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "kind": pa.array([kind] * (n + 1), pa.int32()),
            "size": pa.array([*map(len, keys), 0], pa.int64()),
            "at": pa.array([*where, b""], pa.binary()),
            "more": pa.array([*more, b""], pa.binary()),
            "tokens": pa.array([0] * n + [int(total.sum())], pa.int64()),
            "distinct": pa.array([0] * n + [int((total > 0).sum())], pa.int64()),
        }
    )


def _score(n: int, v: int, starts: int, prior: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(_texts(docs), docs.column("learns").to_numpy(zero_copy_only=False))
        counts = []
        answers = answers.sort_by([("kind", "ascending"), ("shard", "ascending")]).to_pylist() if len(docs) else []
        for kind in (0, 1):
            total, base = chunk.own[kind].astype(np.int64), 0
            for row in (r for r in answers if r["kind"] == kind):
                total[base + _unplanes(row["at"], np.uint32).astype(np.int64)] += _unplanes(row["more"], np.uint64).astype(np.int64)
                base += row["size"]
            counts.append(total)
        automaton = Automaton(chunk, *counts, n, v, starts, prior)
        word = counts[0][chunk.at[0]]
        per_doc = lambda x: np.add.reduceat(x, chunk.first) if len(x) else x
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(chunk.n_tokens),
                "n_known": pa.array(per_doc((word > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(docs), n, dtype=np.int64)),
                "base_score": pa.array(per_doc(automaton.empty_arcs[chunk.at[0]]), pa.float64()),
                "score": pa.array(automaton.walk(chunk.at[0], chunk.first, chunk.n_tokens), pa.float64()),
            }
        )

    return run


def scores(docs: DataFrame, prior: float = PRIOR, chunk_bytes: int = CHUNK, folds: int = 7, held: int = 2) -> DataFrame:
    """``docs (doc_id, text, ..)`` -> ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Documents with crc32(doc_id as text) mod ``folds`` = ``held`` are held out, all others are learnt from (a null id too).
    A text's tokens are its words and one end, so a null or empty text has one. ``base_score`` is that of the empty state
    alone. Repeated rows count as often as they occur. Other columns are ignored. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        F.coalesce(fold == held, F.lit(False)).alias("held_out"),
    ).withColumn("learns", ~F.col("held_out"))
    whole = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("learns").cast("long")).alias("n")).first()
    parts = max(1, -(-(whole.bytes or 0) // chunk_bytes))
    spread = F.xxhash64("doc_id", "text")
    rows = rows.withColumn("chunk", F.pmod(spread, F.lit(parts)).cast("int"))
    asked = rows.groupBy("chunk").applyInArrow(_requests(parts), "chunk int, shard int, kind int, keys binary, counts binary")
    answer = "chunk int, shard int, kind int, size long, at binary, more binary, tokens long, distinct long"
    answers = stored(asked.groupBy("shard", "kind").applyInArrow(_totals, answer))
    sums = answers.filter("chunk = -1 and kind = 0").agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    known = answers.filter("chunk >= 0").select("chunk", "shard", "kind", "size", "at", "more")
    out = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    run = _score(sums.n or 0, sums.v or 0, whole.n or 0, prior)
    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, out)
