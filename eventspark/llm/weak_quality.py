"""A quality classifier learnt without labels.

Overlapping heuristics vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote
patterns (at most 3 ** number of heuristics rows, whatever the number of documents) estimates how often each heuristic is
right in either class, and the posterior of a pattern labels its documents. A linear scorer on hashed byte trigrams is fitted
to the posteriors of a sample of bounded size, and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.session import ready, stored

#: Words that are frequent in ordinary prose of the languages covered. Fixed values.
COMMON = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "auf das dem den der des die ein eine er es ist mit nicht sich sie und von zu "
    "como con del el es las lo los no por se su una y".split()
)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
VOTERS = ("symbols", "capitals", "shouts", "variety", "common", "bars")
BITS = 12
#: Documents the scorer is fitted on, at most.
SAMPLE = 4000
_COMMON = {w.encode() for w in COMMON}


def votes(text: bytes) -> tuple[int, ...]:
    """A vote of each heuristic: 1 good, 2 bad, 0 none."""
    raw = np.frombuffer(text, np.uint8)
    words = text.lower().split()
    if not words:
        return (2,) * len(VOTERS)
    size, n = max(len(raw), 1), len(words)
    count = np.bincount(raw, minlength=256)
    letters = max(count[65:91].sum() + count[97:123].sum(), 1)

    def vote(x: float, good: float, bad: float) -> int:
        return 1 if x <= good else 2 if x >= bad else 0

    return (
        vote(count[SYMBOLS].sum() / size, 0.005, 0.03),
        vote(count[65:91].sum() / letters, 0.1, 0.4),
        vote(count[33] / n, 0.02, 0.3),
        vote(1 - len(set(words)) / n**0.9, 0.4, 0.75),
        vote(1 - sum(map(_COMMON.__contains__, words)) / n, 0.85, 0.97),
        vote(words.count(b"|") / n, 0.02, 0.15),
    )


def pattern(text: bytes) -> int:
    return sum(v * 3**i for i, v in enumerate(votes(text)))


def vector(text: bytes) -> np.ndarray:
    """Hashed byte trigrams: square roots of their counts, scaled to unit length (zero under three bytes)."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    out = np.zeros(1 << BITS, dtype=np.float32)
    if len(raw) > 2:
        grams = (raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)) * np.uint32(2654435761)
        out = np.sqrt(np.bincount(grams >> np.uint32(32 - BITS), minlength=1 << BITS)).astype(np.float32)
        out /= np.sqrt((out * out).sum())
    return out


def fit_voters(counts: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: the patterns as a matrix of votes, and P(good) of each.

    Votes are independent given the class; each heuristic has its own distribution of votes in either class. The start says
    that votes are mostly right, which names the classes; a little prior weight keeps estimates off 0 and 1.
    """
    seen = np.array([[p // 3**i % 3 for i in range(len(VOTERS))] for p in counts], dtype=np.int64).reshape(-1, len(VOTERS))
    n = np.array(list(counts.values()), dtype=float)
    good = (1 + (seen == 1).sum(axis=1)) / (2 + (seen > 0).sum(axis=1))
    for _ in range(rounds):
        log = np.zeros((2, len(seen)))
        for c, weight in enumerate((n * (1 - good), n * good)):
            log[c] = np.log(weight.sum() + 1)
            for i in range(len(VOTERS)):
                share = np.bincount(seen[:, i], weights=weight, minlength=3) + 0.5
                log[c] += np.log(share / share.sum())[seen[:, i]]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return seen, good


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 20.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by full gradient steps with momentum; the last weight is the intercept."""
    w, step = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    x = np.hstack([x, np.full((len(x), 1), 0.3, dtype=x.dtype)]).astype(np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        step = 0.9 * step - rate * 0.1 * (x.T @ (p - y).astype(np.float32) / max(len(x), 1) + decay * w)
        w += step
    w[-1] *= 0.3
    return w


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def classify(docs: DataFrame, sample: int = SAMPLE, cutoff: float = 0.5) -> DataFrame:
    """``docs (doc_id, text, ..)`` -> ``doc_id, posterior`` (of being good, from the votes), ``score`` (of the scorer, 0 to 1)
    and ``kept`` (``score`` is at least ``cutoff`` and the text has words).

    At most ``sample`` documents, those of least hash, are fitted on; votes, their accuracies and scores cover all. A null
    text counts as empty; it gets the votes of a bad document. Repeated rows are scored each; a null doc_id keeps its row.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(t) for t in _texts(batch)], pa.int32())], ["pattern"])

    tallied = texts.select("text").mapInArrow(vote, "pattern int").groupBy("pattern").agg(F.count("*").alias("n"))
    counts = {r.pattern: r.n for r in tallied.orderBy("pattern").collect()}
    _, good = fit_voters(counts)
    posterior = dict(zip(counts, good.tolist(), strict=True))
    total = sum(counts.values())

    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    drawn = texts.withColumn("draw", draw).filter(F.col("draw") <= int((1 << 40) * min(1.0, 1.2 * sample / max(total, 1))))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _texts(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("draw"),
                    pa.array([posterior[pattern(t)] for t in data], pa.float64()),
                    pa.array([vector(t).tobytes() for t in data], pa.binary()),
                ],
                ["draw", "y", "x"],
            )

    fitted_on = drawn.select("draw", "text").mapInArrow(vectors, "draw long, y double, x binary")
    fitted_on = stored(fitted_on.orderBy("draw", "y", "x").limit(sample))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("y", "ascending"), ("x", "ascending")])
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(len(table), -1)
        return pa.table({"w": pa.array([fit_scorer(x, table.column("y").to_numpy()).tobytes()], pa.binary())})

    rows = fitted_on.groupBy(F.lit(1).alias("all")).applyInArrow(fit, "w binary").collect()
    weights = np.frombuffer(rows[0].w) if rows else np.zeros((1 << BITS) + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _texts(batch)
            p = np.array([posterior[pattern(t)] for t in data])
            s = np.array([vector(t) @ weights[:-1] + weights[-1] for t in data])
            s = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
            kept = (s >= cutoff) & np.array([bool(t.strip()) for t in data], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p, pa.float64()), pa.array(s, pa.float64()), pa.array(kept, pa.bool_())],
                ["doc_id", "posterior", "score", "kept"],
            )

    return texts.mapInArrow(score, "doc_id long, posterior double, score double, kept boolean")
