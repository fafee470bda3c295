"""Product codes of vectors: every part gets the index of its nearest codebook entry, found by pivots (LAESA).

Vectors become integers and are cut into consecutive parts. Some first entries of a part position are its pivots; the
distances of all parts to them are computed once and stored with the parts. In each round the distances of pivots and
entries are computed; the difference of the two distances of a pivot is a lower bound of the distance of part and entry.
The entries of a part are tried in the order of their largest lower bound, in whole numbers, until the bound exceeds the
smallest distance found: what is left out cannot be nearer, or as near. Rounds send sums per entry only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from eventspark.llm.session import ready, stored, tasks

PIVOTS = 12
#: Integers of this size and more are refused: squared distances and their sums have to fit into 64 bits.
LARGEST = 1 << 24
#: Parts handled at once, label sums that are broadcast at most, and salts of labels beyond.
CHUNK, BROADCAST, SALTS = 2048, 100_000, 16
#: Relative room for the rounding of stored distances.
SLACK = 1e-6


def _bounds(size: int, parts: int) -> list[slice]:
    at = [size * p // parts for p in range(parts + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def _integers(vectors: list, scale: int) -> np.ndarray:
    x = np.floor(np.array(vectors, dtype=np.float64) * scale)
    if x.size and not np.abs(x).max() < LARGEST:
        raise ValueError(f"a component of {np.abs(x).max() / scale:.3g} is too large for codes at a scale of {scale}")
    return x.astype(np.int64)


def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to those of ``to``."""
    out = np.empty((len(x), len(to)))
    for k, row in enumerate(to):
        out[:, k] = np.sqrt(((x - row) ** 2).sum(axis=1))
    return out


def pivots_of(entries: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the entries, each the farthest from those before."""
    chosen, gap = [0], ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return entries[chosen]


def nearest(x: np.ndarray, far: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry (ties: the lowest) and squared distance for each row of ``x``, and how many distances of
    rows and entries were computed; ``far`` holds the rows' distances to the pivots."""
    index = np.zeros(len(x), dtype=np.int64)
    least = np.full(len(x), np.iinfo(np.int64).max)
    apart = _distances(entries, pivots).astype(np.float32)
    tried = 0
    for lo in range(0, len(x), CHUNK):
        part, close = x[lo : lo + CHUNK], far[lo : lo + CHUNK]
        bound = np.zeros((len(part), len(entries)), dtype=np.float32)
        for p in range(len(pivots)):
            np.maximum(bound, np.abs(close[:, p, None] - apart[None, :, p]), out=bound)
        room = SLACK * (close.max(axis=1) + apart.max())
        order = bound.argsort(axis=1, kind="stable")
        best, at = least[lo : lo + CHUNK], index[lo : lo + CHUNK]
        rows = np.arange(len(part))
        for turn in range(len(entries)):
            e = order[rows, turn]
            lower = np.maximum(bound[rows, e].astype(np.float64) - room[rows], 0)
            open_ = lower * lower * (1 - SLACK) <= best[rows]
            rows, e = rows[open_], e[open_]
            if not len(rows):
                break
            d = ((part[rows] - entries[e]) ** 2).sum(axis=1)
            tried += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (e < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], e[better]
    return index, least, tried


@dataclass(frozen=True)
class Codebook:
    """Entries of every part position, and the pivots the stored distances belong to."""

    entries: list[np.ndarray]
    pivots: list[np.ndarray]

    @property
    def size(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    @property
    def sha256(self) -> str:
        flat = ",".join(str(v) for part in self.entries for entry in part.tolist() for v in entry)
        return hashlib.sha256(flat.encode()).hexdigest()

    def assigned(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(parts, index, squared distance)`` of the rows of a batch for every position."""
        n = batch.num_rows
        values = batch.column("x").flatten().to_numpy().reshape(n, -1).astype(np.int64)
        far = batch.column("far").flatten().to_numpy().reshape(n, -1)
        out, at = [], 0
        for s, entries, pivots in zip(_bounds(self.size, len(self.entries)), self.entries, self.pivots, strict=True):
            part = values[:, s]
            index, least, _ = nearest(part, far[:, at : at + len(pivots)], entries, pivots)
            out.append((part, index, least))
            at += len(pivots)
        return out


def _first(rows: DataFrame, entries: int, parts: int, scale: int, pivots: int) -> Codebook | None:
    """The codebook of the smallest ids (equal ids: the smaller vector); bounded by ``entries`` rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    first = [r.vector for r in first if len(r.vector) == len(first[0].vector)]
    if not first:
        return None
    x = _integers(first, scale)
    cut = [x[:, s] for s in _bounds(x.shape[1], parts)]
    return Codebook(cut, [pivots_of(c, pivots) for c in cut])


def _prepared(rows: DataFrame, book: Codebook, scale: int) -> DataFrame:
    """Integers and distances to the pivots, computed once and written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            x = _integers(values, scale)
            cut = _bounds(book.size, len(book.pivots))
            far = np.concatenate([_distances(x[:, s], p) for s, p in zip(cut, book.pivots, strict=True)], axis=1)
            lists = lambda a, kind: pa.ListArray.from_arrays(
                np.arange(0, a.size + 1, max(1, a.shape[1]), dtype=np.int32) if a.shape[1] else np.zeros(n + 1, np.int32),
                pa.array(a.reshape(-1), kind),
            )
            columns = [batch.column("row"), lists(x, pa.int32()), lists(far, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "x", "far"])

    kind = rows.schema["row"].dataType.simpleString()
    return stored(rows.select("row", "vector").mapInArrow(run, f"row {kind}, x array<int>, far array<float>"))


def _moved(points: DataFrame, book: Codebook) -> Codebook:
    """The codebook after one round: every used entry becomes the floor of the mean of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(e.shape, dtype=np.int64) for e in book.entries]
        counts = [np.zeros(len(e), dtype=np.int64) for e in book.entries]
        for batch in batches:
            for p, (part, index, _) in enumerate(book.assigned(batch)):
                np.add.at(sums[p], index, part)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
        for p, (total, many) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(many)
            each = total.shape[1] + 1
            # place 0 holds the count
            flat = np.concatenate([many[used, None], total[used]], axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.full(flat.size, p), pa.int32()),
                    "entry": pa.array(np.repeat(used, each), pa.int32()),
                    "place": pa.array(np.tile(np.arange(each), len(used)), pa.int32()),
                    "value": pa.array(flat.reshape(-1), pa.int64()),
                }
            )

    found = points.select("x", "far").mapInArrow(run, "part int, entry int, place int, value long")
    # one row per component of the codebook reaches the driver, whatever the input
    found = found.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect()
    return _renewed(book, found)


def _renewed(book: Codebook, found: list[Row]) -> Codebook:
    table = [np.zeros((len(e), e.shape[1] + 1), dtype=np.int64) for e in book.entries]
    for r in found:
        table[r.part][r.entry, r.place] = r.value
    entries = []
    for old, new in zip(book.entries, table, strict=True):
        used = new[:, 0] > 0
        mean = np.floor_divide(new[:, 1:], np.maximum(new[:, :1], 1))
        entries.append(np.where(used[:, None], mean, old))
    return Codebook(entries, book.pivots)


def _coded(points: DataFrame, book: Codebook) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = book.assigned(batch)
            codes = np.stack([index for _, index, _ in found], axis=1)
            error = np.sum([least for _, _, least in found], axis=0)
            text = ["".join(f"{v:02x}" for v in row) for row in codes.tolist()]
            columns = [batch.column("row"), pa.array(text, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "code", "error"])

    kind = points.schema["row"].dataType.simpleString()
    return points.mapInArrow(run, f"row {kind}, code string, error long")


def _with_sums(rows: DataFrame) -> DataFrame:
    """``rows`` with the sum of ``error`` over equal labels (nulls together) as ``label_error``."""
    sums = stored(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= BROADCAST:
        return rows.join(F.broadcast(sums), same, "left").drop("of")
    # a label may hold a large share of the rows
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    sums = sums.select("of", "label_error", F.explode(salts).alias("part"))
    return rows.join(sums, same & (F.col("salt") == F.col("part")), "left").drop("of", "salt", "part")


def product_codes(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
    pivots: int = PIVOTS,
) -> DataFrame:
    """One row per kept vector: ``vec_id, code`` (two hex digits a part), ``error`` (squared distances to the coded
    entries, in units of 1 / ``scale``), ``label_error`` (their sum over equal labels, nulls together), ``codebooks_sha256, label``.

    A vector that is null or holds a null or non-finite component is dropped. Each component x becomes floor(scale * x). The
    codebooks start as the parts of the ``entries`` smallest ids (null ids come last, equal ids go by their vectors), of
    fewer if there are fewer; in each of ``rounds`` rounds entries become the floors of the means of the parts nearest to
    them (ties: the lower index), unused ones stay. A vector of another length than that of the smallest id takes no part:
    its code and errors are null. Lengths that are no multiple of ``parts`` give parts that differ by one component.
    Repeated rows count again; other columns are ignored; without ``label`` all rows have the null label. An empty table
    gives no rows. A component of ``2**24 / scale`` and more is refused by name.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a part's index has two hex digits: 1 to 256 entries, 1 part at least")
    spark = ready(vectors.sparkSession)
    name: Column = F.col(label) if label else F.lit(None).cast("int")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), name.alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: F.coalesce(F.abs(v) < F.lit(math.inf), F.lit(False)))
    rows = rows.filter(F.col("vector").isNotNull() & finite)
    book = _first(rows, entries, parts, scale, pivots)
    out = ["vec_id", "code", "error", "label_error", "codebooks_sha256", "label"]
    if book is None:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.withColumns({"label_error": F.col("error"), "codebooks_sha256": F.lit("")}).select(out).limit(0)
    fits = F.size("vector") == book.size
    # the rounds cost time by rows, not bytes: rows are dealt evenly once
    whole = rows.filter(fits).select(F.struct("vec_id", "label").alias("row"), "vector").repartition(tasks(spark))
    points = _prepared(whole, book, scale)
    for _ in range(rounds):
        book = _moved(points, book)
    coded = _coded(points, book).select("row.vec_id", "row.label", "code", "error")
    others = rows.filter(~fits).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    coded = _with_sums(stored(coded.unionByName(others)))
    return coded.withColumn("codebooks_sha256", F.lit(book.sha256)).select(out)
