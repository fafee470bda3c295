"""Near-duplicate vectors by products of int8 tiles with rigorous error bounds.

Vectors are scaled to unit length and rounded to 8 bits with a scale of their own. For x = s*q + e the product of two
vectors differs from the quantised one by no more than |s*q||e'| + |e| (Cauchy-Schwarz), so most pairs are decided by the
tile product alone; only pairs whose upper bound reaches the threshold are computed again in double precision. The terms of
the bound are two more components of the tile's matrices: one product and one comparison decide a pair. Equal vectors are
one class with a count. A tile returns, per vector, how many vectors it is linked with, and a spanning forest of the links,
never the pairs. Every pair of classes is in exactly one tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.graph import components
from eventspark.llm.joins import join_unique
from eventspark.llm.session import discard, ready, stored, tasks

#: Rows of a block at most and at least, as far as there are enough tasks, and rows compared at once.
BLOCK, LEAST, SUB = 16384, 1024, 1024


def _units(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, lengths of the quantised vectors and lengths of the errors, for unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Matrices whose products of rows are upper bounds of the rows' cosines, and the room their float32 sums need."""
    q, scale, length, error = quantised(x)
    back = q * scale[:, None]
    left = np.concatenate([back, length[:, None], error[:, None]], axis=1)
    right = np.concatenate([back, error[:, None], np.ones((len(x), 1))], axis=1)
    # rounding to float32 and summing so many products, whose absolute values sum up to 8 at most
    return left.astype(np.float32), right.astype(np.float32), (left.shape[1] + 8) * 2.0**-21


def linked_pairs(x: np.ndarray, i: slice, j: slice, parts: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of two slices with cosine >= threshold (of one slice with itself: i < j)."""
    left, right, room = parts
    maybe = left[i] @ right[j].T >= np.float32(threshold - room)
    if i == j:
        maybe = np.triu(maybe, 1)
    a, b = np.divmod(np.flatnonzero(maybe), maybe.shape[1])
    a, b = a + i.start, b + j.start
    hit = np.empty(len(a), dtype=bool)
    for k in range(0, len(a), 1 << 14):
        s = slice(k, k + (1 << 14))
        hit[s] = np.einsum("ij,ij->i", x[a[s]], x[b[s]]) >= threshold
    return a[hit], b[hit]


def _tile(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("cid", "ascending")])
        cid, block = table.column("cid").to_numpy(), table.column("block").to_numpy()
        copies = table.column("copies").to_numpy()
        x = _units(table.column("vector").to_pylist())
        parts = bounds(x)
        left, right = (x.as_py() for x in key)
        split = int(np.searchsorted(block, right)) if left != right else len(cid)
        cut = lambda lo, hi: [slice(k, min(k + SUB, hi)) for k in range(lo, hi, SUB)]
        own = cut(0, split)
        pairs = [(s, t) for n, s in enumerate(own) for t in own[n:]] if left == right else [
            (s, t) for s in own for t in cut(split, len(cid))
        ]
        links = np.zeros(len(cid), dtype=np.int64)
        root = np.arange(len(cid))
        ends_a, ends_b = [], []
        for s, t in pairs:
            a, b = linked_pairs(x, s, t, parts, threshold)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            # ends that are already joined need no further edge
            while len(a):
                ra, rb = root[a], root[b]
                apart = ra != rb
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                if not len(a):
                    break
                low, high = np.minimum(ra, rb), np.maximum(ra, rb)
                # one edge for each higher root
                _, pick = np.unique(high, return_index=True)
                ends_a.append(a[pick])
                ends_b.append(b[pick])
                root[high[pick]] = low[pick]
                while (again := root[root]).tolist() != root.tolist():
                    root = again
        a = np.concatenate(ends_a) if ends_a else np.empty(0, np.int64)
        b = np.concatenate(ends_b) if ends_b else np.empty(0, np.int64)
        some = np.flatnonzero(links)
        nothing = pa.nulls(len(a), pa.int64())
        return pa.table(
            {
                "cid": pa.concat_arrays([pa.array(cid[some]), pa.array(cid[a])]),
                "links": pa.concat_arrays([pa.array(links[some]), nothing]),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cid[b])]),
            }
        )

    return run


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """One row per vector: ``vec_id, n_links`` (other vectors with cosine >= ``threshold``), ``component_id`` (the smallest
    vec_id reachable by links) and ``kept`` (whether that is its own).

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing. Vectors of different
    dimensions never link. Repeated rows and equal vectors count as vectors of their own. A null id keeps its row. All other
    columns are ignored. An empty table gives no rows.
    """
    spark = ready(vectors.sparkSession)
    kind = vectors.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    finite = F.forall("vector", lambda v: F.coalesce(F.abs(v) < F.lit(math.inf), F.lit(False)))
    good = F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    # 128 bits stand for a vector; a component of -0.0 equals 0.0
    plain = F.transform("vector", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))
    mark = F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(F.lit("b"), plain).alias("b"))
    rows = rows.withColumn("mark", F.when(good, mark))
    found = rows.filter("mark is not null").groupBy("mark").agg(F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = stored(found.withColumn("cid", F.monotonically_increasing_id()))
    # blocks of classes of one dimension: few, as each vector is sent to as many tiles, but enough for all tasks
    enough = math.ceil(math.sqrt(6 * tasks(spark)))
    count = F.count("*")
    blocks = F.greatest(F.ceil(count / block), F.least(F.lit(enough), F.ceil(count / LEAST))).cast("int")
    sizes = classes.groupBy(F.size("vector").alias("dim")).agg(blocks.alias("blocks"))
    dealt = classes.repartition(tasks(spark)).withColumn("dim", F.size("vector")).join(F.broadcast(sizes), "dim")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    mates = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")),
    )
    tiles = dealt.select("dim", "block", "cid", "copies", "vector", F.inline(mates))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _tile(threshold)(key[1:], table)

    # work grows with the square of a tile's rows: a number of partitions by bytes would put all tiles into a few tasks
    tiles = tiles.repartition(tasks(spark), "dim", "i", "j")
    found = stored(tiles.groupBy("dim", "i", "j").applyInArrow(run, "cid long, links long, other long"))
    counts = found.filter("links is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    joined = joined.select(F.col("node").alias("cid"), "root")
    info = classes.select("mark", "cid", "copies").join(counts, "cid", "left").join(joined, "cid", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    info = stored(info.select("mark", "copies", F.coalesce("root", "cid").alias("root"), n_links.alias("n_links")))
    placed = stored(join_unique(rows.select("vec_id", "mark"), info, "mark", "copies").drop("mark"))
    least = placed.filter("root is not null").groupBy("root")
    least = stored(least.agg(F.min("vec_id").alias("component_id"), F.count("*").alias("members")))
    discard(classes, found, info)
    out = join_unique(placed, least, "root", "members")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
