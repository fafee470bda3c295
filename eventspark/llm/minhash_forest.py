"""Near-duplicate documents by a MinHash LSH forest.

Every distinct set of word shingles gets a signature of ``VALUES`` minima. The forest has ``TREES`` sorted orders of the
signatures, each starting at another value; sets that agree in the first values of an order form a region of it.

1. *Neighbours.* In the first orders, blocks of sets that follow one another, hence share the longest prefixes, are
   compared exactly. This joins most groups of copies at a cost in proportion to their size.
2. *Regions.* In all orders, whatever the first step left apart inside a region is compared exactly. A region that holds
   many components is deepened, value by value, up to ``deepest(percent)``; only pairs between different components are looked
   at, the largest component of a region in one row of tiles against the rest, so a group of thousands of copies is not
   compared with itself again.

Pairs never leave a task: a tile gives a spanning forest of its links. Links hold on the full sets (48-bit hashes of
shingles). A pair at a threshold of 85 % is missed by all regions with a probability of about 2e-7, and of up to about 5e-4
if all its regions are crowded enough to be deepened to six values; at 80 %, of about 1e-5, and of up to about 2e-4 if all
are deepened to four.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.llm.graph import components
from eventspark.llm.joins import join_unique
from eventspark.llm.session import discard, ready, stored, tasks
from eventspark.llm.words import mix, shingles

TREES, STEP = 16, 4
VALUES = TREES * STEP
SHALLOWEST, DEEPEST = 3, 6
#: How often a pair at the threshold may be in no common region where all its regions are deepened.
MISSED = 6e-4
FIRST_TREES = 2
BLOCK, TILE, CROWD = 96, 256, 64
_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def deepest(percent: int) -> int:
    """The most values, up to ``DEEPEST``, that regions may share before pairs at the threshold are missed too often."""
    missed = lambda d: (1 - (percent / 100) ** d) ** TREES
    return max(d for d in range(SHALLOWEST + 1, DEEPEST + 1) if d == SHALLOWEST + 1 or missed(d) <= MISSED)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of a non-empty set under ``VALUES`` bijections of 32 bits."""
    low = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, ((x[i : i + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    return low


def pack(hashes: np.ndarray) -> bytes:
    """A set as 48-bit values."""
    return hashes.astype(np.uint32).tobytes() + (hashes >> np.uint64(32)).astype(np.uint16).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    high = np.frombuffer(blob, np.uint16, n, 4 * n).astype(np.uint64)
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) | (high << np.uint64(32))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few sets, by products of slices of their incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    twice = times[item] > 1
    owner, item = owner[twice], column[item[twice]]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 4096
    for first in range(0, int(item[-1]) + 1 if len(item) else 0, width):
        lo, hi = np.searchsorted(item, [first, first + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[lo:hi], item[lo:hi] - first] = 1
        out += part @ part.T
    return out


def forest(ids: np.ndarray, groups: np.ndarray, blobs: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links between different groups that join everything the links of these sets join, and no more than needed."""
    sets = [unpack(x) for x in blobs]
    size = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    union = size[:, None] + size[None, :] - both
    linked = (100 * both >= percent * union) & (groups[:, None] != groups[None, :])
    root = {int(g): int(g) for g in groups}

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
        a, b = find(int(groups[i])), find(int(groups[j]))
        if a != b:
            root[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingles(text or b"", k)
                n.append(len(s))
                if len(s):
                    key.append(mix(s, 1).sum().tobytes() + mix(s, 2).sum().tobytes())
                    sig.append(signature(s).astype(">u4").tobytes())
                else:
                    key.append(None)
                    sig.append(None)
            cols = [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "key", "sig"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [pack(shingles(x, k)) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(blobs, pa.binary())], ["cid", "words"])

    return run


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every set once per order, with its region there."""
    for batch in batches:
        cid = batch.column("cid").to_numpy()
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=">u4").reshape(len(cid), VALUES)
        for tree in range(TREES):
            prefix = sig[:, tree * STEP : tree * STEP + SHALLOWEST].astype(np.uint64)
            region = np.full(len(cid), tree + 1, dtype=np.uint64)
            for v in prefix.T:
                region = mix(region * np.uint64(0x9E3779B97F4A7C15) + v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cid), tree, np.int32)), pa.array(region.astype(np.int64)), pa.array(cid)],
                ["tree", "region", "cid"],
            )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ``BLOCK`` rows that follow one another in the sorted partition."""
    from pyspark import TaskContext

    at, base = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        block = base + (at + np.arange(batch.num_rows)) // BLOCK
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("cid")], ["block", "cid"])


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.group_by("cid").aggregate([("group", "min"), ("words", "min")])
        ids = table.column("cid").to_numpy()
        groups = table.column("group_min").to_numpy()
        links = forest(ids, groups, table.column("words_min").to_pylist(), percent) if len(ids) > 1 else []
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _tree_order(sig: str, tree: Column) -> Column:
    """The signature turned to where an order starts (big-endian bytes sort as the values do)."""
    s = F.concat(sig, sig)
    return F.substring(s, tree * (4 * STEP) + 1, F.lit(4 * VALUES))


def _stats(rows: DataFrame) -> DataFrame:
    """Per region: components, rows, the largest component, and two independent marks of its set of documents."""
    per = rows.groupBy("region", "group").agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("cid") % 2**40).alias("mark"),
        F.bit_xor(F.xxhash64(F.lit("mark"), "cid")).alias("mark2"),
    )
    return per.groupBy("region").agg(
        F.count("*").alias("n_groups"),
        F.sum("n").alias("n_rows"),
        F.max("n").alias("n_top"),
        F.max_by("group", F.struct("n", "group")).alias("top"),
        F.sum("mark").alias("mark"),
        F.bit_xor("mark2").alias("mark2"),
    )


def _between(members: DataFrame, classes: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different groups of a region, for all regions at the depth that suits each."""
    last = deepest(percent)
    rows = members.join(groups, "cid", "left").withColumn("group", F.coalesce("group", "cid"))
    at = stored(_stats(rows).filter("n_groups > 1"))
    crowded = at.filter(F.col("n_groups") > CROWD).select("region")
    deep = rows.join(crowded, "region", "left_semi").join(classes.select("cid", "sig"), "cid")
    order = _tree_order("sig", F.col("tree"))
    at_depth = F.transform(
        F.sequence(F.lit(SHALLOWEST + 1), F.lit(last)),
        lambda d: F.struct(d.alias("depth"), F.xxhash64("tree", d, F.substring(order, F.lit(1), 4 * d)).alias("region")),
    )
    deep = stored(deep.select("tree", "cid", "group", F.inline(at_depth)))
    fits = _stats(deep).filter("n_groups > 1")
    chosen = (
        deep.join(fits, "region")
        .filter((F.col("n_groups") <= CROWD) | (F.col("depth") == last))
        .groupBy("tree", "cid", "group")
        .agg(F.min(F.struct("depth", "region", *at.columns[1:])).alias("x"))
        .select("cid", "group", "x.*")
        .drop("depth")
    )
    plain = rows.join(at.filter(F.col("n_groups") <= CROWD), "region").select("cid", "group", *at.columns)
    found = plain.unionByName(chosen)
    # the same sets together in several orders: one of these regions is enough
    once = found.groupBy("mark", "mark2", "n_rows").agg(F.min("region").alias("region")).select("region")
    found = found.join(once, "region", "left_semi")
    is_top = F.col("group") == F.col("top")
    n_a = F.ceil(F.col("n_top") / TILE).cast("int")
    n_b = F.ceil((F.col("n_rows") - F.col("n_top")) / TILE).cast("int")
    mine = F.pmod(F.xxhash64("cid"), F.when(is_top, n_a).otherwise(n_b)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    rest = F.transform(upto(n_b), lambda j: tile(1, F.least(F.col("mine"), j), F.greatest(F.col("mine"), j)))
    tiles = F.when(is_top, F.transform(upto(n_b), lambda j: tile(0, F.col("mine"), j))).otherwise(
        F.concat(
            F.transform(upto(n_a), lambda i: tile(0, i, F.col("mine"))),
            F.when(n_b > 1, rest).otherwise(F.slice(rest, 1, 0)),
        )
    )
    dealt = found.withColumn("mine", mine).select("cid", "group", "region", F.inline(tiles))
    return (
        dealt.join(sets, "cid")
        .groupBy("region", "kind", "i", "j")
        .applyInArrow(_compare(percent), "a long, b long")
    )


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """``docs (doc_id, text, ..)`` -> one row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if their sets of ``k``-word shingles have 100 * intersection >= ``percent`` * union
    (``percent`` of 80 or more); ``component_id`` is the smallest doc_id reachable by links and ``kept`` marks the row
    with that id. Repeated rows each get their row. A null or empty text, or one without words, has an empty set and is
    linked with nothing; fewer than ``k`` words make one shingle. A null doc_id keeps its row and never is a component's
    id unless there is no other. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    sketches = stored(
        texts.mapInArrow(_sketches(k), "doc_id long, text_hash long, n_shingles long, key binary, sig binary")
    )
    rows = sketches.drop("sig")
    one = F.min(F.struct(F.isnull("doc_id"), "doc_id", "text_hash")).alias("one")
    classes = stored(
        sketches.filter("key is not null")
        .groupBy("key")
        .agg(one, F.first("sig").alias("sig"), F.count("*").alias("copies"))
        .select("key", "one.doc_id", "one.text_hash", "sig", "copies")
        .withColumn("cid", F.monotonically_increasing_id())
    )
    regions = classes.select("cid", "sig").mapInArrow(_orders, "tree int, region long, cid long")
    shared = regions.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(regions.join(shared.select("region"), "region", "left_semi"))
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi")
    wanted = wanted.select("cid", F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"))
    match = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash"))
    sets = texts.join(wanted, match).select("cid", "text").mapInArrow(_sets(k), "cid long, words binary")
    sets = stored(sets.dropDuplicates(["cid"]))

    order = members.filter(F.col("tree") < FIRST_TREES).join(classes.select("cid", "sig"), "cid")
    order = stored(order.select("tree", _tree_order("sig", F.col("tree")).substr(1, 32).alias("at"), "cid"))
    sorted_rows = order.repartitionByRange(tasks(spark), "tree", "at", "cid").sortWithinPartitions("tree", "at", "cid")
    blocks = sorted_rows.mapInArrow(_numbered, "block long, cid long")
    near = blocks.join(sets, "cid").withColumn("group", F.col("cid"))
    first = components(near.groupBy("block").applyInArrow(_compare(percent), "a long, b long"))
    groups = first.select(F.col("node").alias("cid"), F.col("root").alias("group"))
    links = _between(members, classes, groups, sets, percent)
    of = lambda end: groups.select(F.col("cid").alias(end), F.col("group").alias(f"{end}_group"))
    links = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    links = links.select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
    second = components(links)
    second = second.select(F.col("node").alias("group"), F.col("root").alias("later"))
    roots = classes.select("key", "cid", "doc_id", "copies").join(groups, "cid", "left")
    roots = roots.withColumn("group", F.coalesce("group", "cid")).join(second, "group", "left")
    roots = stored(roots.select("key", "doc_id", "copies", F.coalesce("later", "group").alias("root")))
    least = stored(roots.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes")))
    known = stored(join_unique(roots.drop("doc_id"), least, "root", "classes").drop("root"))
    discard(members, sets, order, roots, least)
    out = join_unique(rows.select("doc_id", "n_shingles", "key"), known, "key", "copies")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
