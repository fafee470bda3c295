"""The second plan for collections: items of very large events stay rows.

An event with up to ``LIMIT`` items is one row with arrays (:mod:`nest`). The items of a larger one are never brought
together: counts and firsts combine per event from partial aggregates, positions come from a global sort and a table of
partition totals, and whatever compares items with items joins them chunk by chunk on (event, chunk, chunk). Which plan an
event takes depends on its measured size only; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.functions import coll, kin, ops
from eventspark.operators.checkpoints import pinned
from eventspark.operators.literal import MAX_BROADCAST_ROWS

#: Items of an event that is still nested, and items of a chunk.
LIMIT, CHUNK = 4096, 1024
_KNOWN: dict[tuple, DataFrame | None] = {}


def crowded_keys(items: DataFrame, key: str, limit: int | None = None) -> DataFrame | None:
    """``(key, size)`` of the events with more than ``limit`` items, or None if there are none.

    Measured by one aggregation for a set of files, then known for the session.
    """
    limit = LIMIT if limit is None else limit
    known = (items.sparkSession.sparkContext.applicationId, key, limit, *sorted(items.inputFiles()))
    if known not in _KNOWN:
        counted = items.groupBy(key).agg(F.count("*").alias("size")).filter(F.col("size") > limit)
        counted = pinned(counted.filter(F.col(key).isNotNull()))
        _KNOWN[known] = None if counted.isEmpty() else counted
    return _KNOWN[known]


def split(df: DataFrame, key: str, keys: DataFrame, crowded: bool) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``keys``, or those of all others."""
    small = keys.count() <= MAX_BROADCAST_ROWS
    which = keys.select(F.col(keys.columns[0]).alias("_of"))
    return df.join(F.broadcast(which) if small else which, F.col(key) == F.col("_of"), "left_semi" if crowded else "left_anti")


def numbered(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``rows`` with their position (from 0) in the ``order`` of their ``key``; (key, order) is unique or ties are alike."""
    dealt = rows.repartitionByRange(key, order).sortWithinPartitions(key, order)
    dealt = pinned(dealt.withColumn("_id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))
    # one row for each event and partition
    parts = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(
        F.min("_id").alias("_first"), F.count("*").alias("_n")
    )
    before = W.partitionBy("_key").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_key", "_of", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = dealt.join(parts, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")))
    position = (F.col("_id") + F.col("_shift")).cast("int")
    return joined.withColumn(name, position).drop("_id", "_part", "_key", "_of", "_shift")


@dataclass(frozen=True)
class Items:
    """One collection of crowded events: ``rows (key, size, at, item)``.

    ``item`` is the struct an array would hold, with ``idx``, its position in the stored collection; ``at`` orders the items
    of an event; ``size`` exceeds every ``idx`` of the event.
    """

    rows: DataFrame
    key: str

    def _on(self, rows: DataFrame) -> Items:
        return replace(self, rows=rows)

    def pinned(self) -> Items:
        """The same stored once: what is derived from it starts there, and plans stay small."""
        return self._on(pinned(self.rows))

    def select(self, pred: coll.Predicate) -> Items:
        return self._on(self.rows.filter(ops.passed(pred(F.col("item")))))

    def mapped(self, value: Callable[[Column], Column]) -> Items:
        return self._on(self.rows.withColumn("item", value(F.col("item"))))

    def sort(self, by: Callable[[Column], Column], desc: bool = False) -> Items:
        """Items by ``by``; equal ones keep the order of ``idx``."""
        value = by(F.col("item"))
        at = F.struct((-value if desc else value).alias("k"), F.col("item.idx").alias("i"))
        return self._on(self.rows.withColumn("at", at))

    def counts(self, **preds: Column) -> DataFrame:
        """``key`` and, per name, the number of items that satisfy a condition on ``item``; events without items have no row."""
        return self.rows.groupBy(self.key).agg(*[F.count_if(ops.passed(p)).alias(n) for n, p in preds.items()])

    def positions(self) -> DataFrame:
        """``(key, pos, item)``."""
        return numbered(self.rows, self.key, "at", "pos").select(self.key, "pos", "item")

    def first(self, name: str) -> DataFrame:
        """``(key, name)`` with the first item of each event."""
        return self.rows.groupBy(self.key).agg(F.min_by("item", "at").alias(name))

    def heads(self, name: str, n: int = 2) -> DataFrame:
        """``(key, name)`` with an array of the first ``n`` items, followed by a null for each further one: its length and
        its first items are those of the whole collection."""
        rows, out = self.rows.select(self.key, "size", "at", "item"), None
        for i in range(n):
            best = rows.groupBy(self.key).agg(F.min("at").alias(f"_at{i}"), F.min_by("item", "at").alias(f"_i{i}"))
            if i + 1 < n:
                rows = self._with_event(rows, best.select(self.key, f"_at{i}"))
                rows = rows.filter(F.col("at") > F.col(f"_at{i}")).drop(f"_at{i}")
            best = best.drop(f"_at{i}")
            out = best if out is None else out.join(best, self.key, "left")
        sizes = self.rows.groupBy(self.key).agg(F.count("*").cast("int").alias("_n"))
        first = F.filter(F.array(*[f"_i{i}" for i in range(n)]), lambda x: x.isNotNull())
        rest = F.array_repeat(F.lit(None), F.greatest(F.col("_n") - n, F.lit(0)))
        return out.join(sizes, self.key).select(self.key, F.concat(first, rest).alias(name))

    def _with_event(self, rows: DataFrame, facts: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``facts``, one row per event, sent once to each of the event's chunks."""
        chunks = rows.withColumn("_chunk", F.floor(F.col("item.idx") / CHUNK))
        every = rows.groupBy(F.col(self.key).alias("_event")).agg(F.max(F.floor(F.col("size") / CHUNK)).alias("_last"))
        sent = facts.join(every, F.col(self.key) == F.col("_event")).drop("_event")
        sent = sent.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).drop("_last")
        return chunks.join(sent, [self.key, "_chunk"], "left").drop("_chunk")

    def with_event(self, facts: DataFrame) -> Items:
        """The same with columns of ``facts (key, ..)`` beside ``item``, null where an event has none there."""
        return self._on(self._with_event(self.rows, facts))

    def follow(self, target: Items, ref: str, name: str) -> Items:
        """The same with the item of ``target`` that ``item.<ref>`` points to as a column ``name``, or null."""
        there = target.rows.select(F.col(self.key).alias("_event"), F.col("item.idx").alias("_ref"), F.col("item").alias(name))
        match = (F.col(self.key) == F.col("_event")) & (F.col(f"item.{ref}") == F.col("_ref"))
        return self._on(self.rows.join(there, match, "left").drop("_event", "_ref"))

    def _deal(self, name: str, mine: str, other: str) -> DataFrame:
        """Items once for each chunk of the other side."""
        every = F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / CHUNK))
        rows = self.rows.select(self.key, F.col("item").alias(name), F.explode(every).alias(other))
        return rows.withColumn(mine, F.floor(F.col(f"{name}.idx") / CHUNK))

    def pairs(self, other: Items | None, pred: coll.PairPredicate) -> DataFrame:
        """``(key, l1, l2)``: pairs of one item here and one of ``other`` (None: two different ones, the earlier ``idx``
        first) that satisfy ``pred``, chunk by chunk."""
        left, right = self._deal("l1", "_a", "_b"), (other or self)._deal("l2", "_b", "_a")
        hit = ops.passed(pred(F.col("l1"), F.col("l2")))
        if other is None:
            hit = hit & (F.col("l1.idx") < F.col("l2.idx"))
        joined = left.join(right, [self.key, "_a", "_b"])
        return joined.filter(hit).select(self.key, "l1", "l2")

    def has_pair(self, other: Items | None, pred: coll.PairPredicate) -> DataFrame:
        """The events with at least one of :meth:`pairs`, as ``key``."""
        return self.pairs(other, pred).select(self.key).distinct()

    def without(self, other: Items, near: coll.PairPredicate) -> Items:
        """Items for which no item of ``other`` satisfies ``near``."""
        hit = self.pairs(other, near).select(F.col(self.key).alias("_event"), F.col("l1.idx").alias("_idx")).distinct()
        match = (F.col(self.key) == F.col("_event")) & (F.col("item.idx") == F.col("_idx"))
        return self._on(self.rows.join(hit, match, "left_anti"))

    def clean(self, other: Items, dr: float) -> Items:
        """Items with no item of ``other`` within ``dr`` (inclusive)."""
        return self.without(other, lambda x, y: kin.delta_r(x, y) <= dr)

    def keep_apart(self, axes: DataFrame, column: str, dr: float) -> Items:
        """Items at distance ``>= dr`` from every axis in the event's array ``column`` of ``axes (key, column)``."""
        far = F.forall(column, lambda y: ops.passed(ops.at_least(kin.delta_r(F.col("item"), y), dr)))
        kept = self.with_event(axes).rows.filter(F.col(column).isNull() | far)
        return self._on(kept.drop(column))


def items_of(rows: DataFrame, key: str, order: Column, item: Callable[[Column, Column, Column], Column]) -> Items:
    """A collection from flat ``rows`` of crowded events: ordered by ``order``, each made by ``item(row, position, size)``."""
    fields = [c for c in rows.columns if c != key]
    placed = numbered(rows.withColumn("_order", order), key, "_order", "_pos").select(
        key, F.col("_pos"), F.struct(*fields).alias("_row")
    )
    sizes = placed.groupBy(F.col(key).alias("_event")).agg(F.count("*").cast("int").alias("size"))
    sizes = sizes.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / CHUNK))))
    placed = placed.withColumn("_of", F.floor(F.col("_pos") / CHUNK))
    placed = placed.join(sizes, (F.col(key) == F.col("_event")) & (F.col("_of") == F.col("_chunk")))
    made = item(F.col("_row"), F.col("_pos"), F.col("size"))
    return Items(placed.select(key, "size", F.struct(F.col("_pos").alias("i")).alias("at"), made.alias("item")), key)


def renumbered(items: Items) -> Items:
    """The items that are left as a stored collection of their own: ``idx`` becomes their position."""
    rows = numbered(items.rows, items.key, "at", "_pos")
    at = F.struct(F.col("_pos").alias("i"))
    return Items(rows.select(items.key, "size", at.alias("at"), F.col("item").withField("idx", F.col("_pos")).alias("item")), items.key)
