"""Groups of spelling variants: frequent words one edit apart, found by dense tiles of code points.

Two words are one insertion, deletion or replacement apart if the lengths of their common prefix and common suffix reach
the longer length minus one. So one of the two has at least half the longer length, and near words share that prefix or
that suffix: words are dealt into buckets by (longer length, side, half), each word for its own length and for the next.
Inside a bucket, code points are padded into matrices, blocks of rows are compared with blocks, and both common lengths
come from the first difference from either end. The side of the prefix takes pairs that share the half prefix, the side of
the suffix the others, so each pair counts once. A bucket of many words is cut into blocks, one tile for each pair of them.
A tile returns for each of its words the number of near ones and the most frequent of them, never the pairs.
"""

from __future__ import annotations

import binascii
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.session import ready, stored, tasks

BLOCK = 2048
#: Code points compared at once, and code points of a block at most (a block of longer words has fewer rows).
CELLS, BLOCK_CELLS = 1 << 22, 1 << 22
#: Distinct words a task holds while it counts, rows of a tile of small buckets, and rows of a broadcast table at most.
HELD, TILE, BROADCAST = 500_000, 20_000, 100_000
_UPPER = {c: c + 32 for c in range(65, 91)}


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6) -> DataFrame:
    """``(word, n)``, one or more rows per word: maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased.

    Where 199 divides the crc32 of ``<doc_id>:<run>``, the run loses its code point crc32 % length. Words of fewer than
    ``least`` code points are left out. A null text has no words; a null id is written as nothing.
    """
    run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_pydict(
            {"word": pa.array(totals.keys(), pa.string()), "n": pa.array(totals.values(), pa.int64())}
        )
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = binascii.crc32(f"{doc}:".encode())
                runs: Counter[str] = Counter()
                for raw, n in Counter(run.findall(body)).items():
                    runs[raw.lower() if raw.isascii() else raw.translate(_UPPER)] += n
                for word, n in runs.items():
                    h = binascii.crc32(word.encode(), seed)
                    if h % 199 == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    totals[word] += n
                if len(totals) > HELD:
                    yield out()
                    totals.clear()
        yield out()

    ready(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.col(text).cast("string").alias("text"))
    return texts.filter("text is not null").mapInArrow(count, "word string, n long")


def _matrix(words: np.ndarray, lengths: np.ndarray, width: int, pad: int, right: bool) -> np.ndarray:
    """Code points of ``words`` in rows of ``width``, padded after their ends, or before their starts if ``right``."""
    codes = words.astype(f"U{width}").view(np.uint32).reshape(len(words), width)
    at = np.arange(width) - (width - lengths if right else 0 * lengths)[:, None]
    inside = (at >= 0) & (at < lengths[:, None])
    taken = np.take_along_axis(codes, np.where(inside, at, 0), axis=1)
    return np.where(inside, taken, np.uint32(pad))


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the equal run from the left, for every row of ``a`` with every row of ``b``."""
    equal = a[:, None, :] == b[None, :, :]
    first = equal.argmin(axis=2)
    return np.where((first == 0) & equal[:, :, 0], a.shape[1], first)


def near_pairs(words: list[str], width: int, split: int | None, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the near pairs of one bucket whose longer word has ``width`` code points.

    With ``split``, rows before it are compared with those from it on; without, all are compared with each other. Pairs that
    share half the width as a prefix belong to the buckets of prefixes, the others to those of suffixes.
    """
    lengths = np.array([len(w) for w in words])
    names = np.array(words, dtype=object)
    step = max(1, min(1024, int((CELLS / width) ** 0.5)))
    cut = lambda lo, hi: [slice(k, min(k + step, hi)) for k in range(lo, hi, step)]
    if split is None:
        own = cut(0, len(words))
        tiles = [(s, t) for n, s in enumerate(own) for t in own[n:]]
    else:
        tiles = [(s, t) for s in cut(0, split) for t in cut(split, len(words))]
    found_a, found_b = [], []
    # pads beyond the code points that differ on both sides: no padding equals anything
    sides = {
        (s.start, pad): tuple(_matrix(names[s], lengths[s], width, pad, right) for right in (False, True))
        for pair in tiles
        for s, pad in zip(pair, (0x110000, 0x110001), strict=True)
    }
    for s, t in tiles:
        (left_a, right_a), (left_b, right_b) = sides[s.start, 0x110000], sides[t.start, 0x110001]
        before = _same(left_a, left_b)
        after = _same(right_a[:, ::-1], right_b[:, ::-1])
        near = (before + after >= width - 1) & ((before >= width // 2) == prefix)
        near &= (lengths[s, None] == width) | (lengths[None, t] == width)
        if s == t:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        found_a.append(a + s.start)
        found_b.append(b + t.start)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _tile(table: pa.Table) -> pa.Table:
    """Near words of the buckets of a tile: per word their number and the most frequent (ties: the smallest)."""
    table = table.sort_by([(c, "ascending") for c in ("width", "prefix", "bucket", "i", "j", "block", "word")])
    key = [table.column(c).to_numpy(zero_copy_only=False) for c in ("width", "prefix", "bucket", "i", "j")]
    block, n = table.column("block").to_numpy(), table.column("n").to_numpy()
    words = table.column("word").to_pylist()
    change = np.ones(len(words), dtype=bool)
    change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in key])
    starts = [*np.flatnonzero(change).tolist(), len(words)]
    ends_a, ends_b = [], []
    for lo, hi in zip(starts, starts[1:], strict=False):
        if hi - lo < 2:
            continue
        i, j = key[3][lo], key[4][lo]
        split = None if i == j else int(np.searchsorted(block[lo:hi], j))
        a, b = near_pairs(words[lo:hi], int(key[0][lo]), split, bool(key[1][lo]))
        ends_a += [a + lo, b + lo]
        ends_b += [b + lo, a + lo]
    none = np.empty(0, np.int64)
    a, b = np.concatenate([none, *ends_a]), np.concatenate([none, *ends_b])
    names = np.array(words, dtype=object)
    rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")
    a, b = (x[np.lexsort((rank[b], -n[b], a))] for x in (a, b))
    at, first, many = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    return pa.table(
        {
            "word": pa.array(names[at], pa.string()),
            "n_near": pa.array(many, pa.int64()),
            "form": pa.array(names[best], pa.string()),
            "form_n": pa.array(n[best], pa.int64()),
        }
    )


def _dealt(vocabulary: DataFrame, size: int, block: int) -> DataFrame:
    """Words with their buckets, and the tiles of the blocks of buckets with many words."""
    spark = vocabulary.sparkSession
    length = F.length("word")

    def places(width: Column) -> list[Column]:
        half = F.floor(width / 2).cast("int")
        return [
            F.struct(width.alias("width"), F.lit(True).alias("prefix"), F.xxhash64(F.substring("word", 1, half)).alias("bucket")),
            F.struct(
                width.alias("width"),
                F.lit(False).alias("prefix"),
                F.xxhash64(F.substring("word", length - half + 1, half)).alias("bucket"),
            ),
        ]

    rows = vocabulary.select("word", "n", F.inline(F.array(*places(length), *places(length + 1))))
    where = ["width", "prefix", "bucket"]
    rows_of_block = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_CELLS) / F.col("width")))).cast("long")
    many = rows.groupBy(where).agg(F.count("*").alias("rows")).filter(F.col("rows") > rows_of_block)
    many = stored(many.select(*where, F.ceil(F.col("rows") / rows_of_block).cast("int").alias("blocks")))
    # few can be large: the table has at most 4 / ``block`` rows a word, unless words are very long
    few = many.count() <= BROADCAST
    rows = rows.join(F.broadcast(many) if few else many, where, "left")
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("word", F.lit(1)), blocks).cast("int")
    mates = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")),
    )
    tiles = max(tasks(spark), -(-4 * size // TILE))
    small = F.pmod(F.xxhash64(*where), F.lit(tiles))
    rows = rows.withColumns({"block": mine, "tile": F.when(F.col("blocks").isNull(), small).otherwise(F.xxhash64(*where))})
    return rows.select("word", "n", *where, "block", "tile", F.inline(mates))


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(word, n_near, form, form_n)`` for the words of ``vocabulary (word, n)`` that have a near one; words are distinct."""
    ready(vocabulary.sparkSession)
    tiles = _dealt(vocabulary, vocabulary.count(), block)
    tiles = tiles.repartition(tasks(vocabulary.sparkSession), "tile", "i", "j")
    found = tiles.groupBy("tile", "i", "j").applyInArrow(_tile, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms (word, form)`` without cycles: the last word of the chain of forms."""
    done = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        later = done.select(F.col("word").alias("root"), F.col("root").alias("later"))
        step = stored(done.join(later, "root", "left").select("word", F.coalesce("later", "root").alias("root"), "later"))
        if step.filter("later is not null").isEmpty():
            return step.select("word", "root")
        done = step.select("word", "root")


def variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    block: int = BLOCK,
) -> DataFrame:
    """One row per word of at least ``least`` code points and ``min_count`` occurrences: ``word, form, root, n, n_near, form_n``.

    Near words differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word with the largest
    count (ties: the smallest in code-point order) if that is at least ``ratio`` times the word's own, else null, like
    ``form_n``; ``root`` is the last word along the forms. Null texts have no words, a null id is written as nothing,
    repeated rows count again, other columns are ignored. An empty table gives no rows.
    """
    counts = counted_words(docs, doc_id, text, least).groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = stored(counts.filter(F.col("n") >= min_count))
    near = vocabulary.join(near_words(vocabulary, block), "word", "left")
    strong = F.col("form_n") >= ratio * F.col("n")
    forms = stored(
        near.select(
            "word",
            F.when(strong, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("form_n")).alias("form_n"),
        )
    )
    ends = roots(forms.filter("form is not null"))
    out = forms.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
