"""Operators on one event's collections (``array<struct>`` columns).

Every function is a row-local expression: no shuffle, no Python worker. Items carry ``idx``, their position in the
stored collection, which also breaks ties when sorting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions import kin, ops

Predicate = Callable[[Column], Column]
PairPredicate = Callable[[Column, Column], Column]


def select(arr: Column, pred: Predicate) -> Column:
    """Items that satisfy ``pred``, in order."""
    return F.filter(arr, lambda x: F.coalesce(pred(x), F.lit(False)))


def with_field(arr: Column, name: str, value: Callable[[Column], Column]) -> Column:
    return F.transform(arr, lambda x: x.withField(name, value(x)))


def with_idx(arr: Column) -> Column:
    """Stamp each item with its 0-based position."""
    return F.transform(arr, lambda x, i: x.withField("idx", i))


def rows(df: DataFrame, arr: Column | str, *keep: str) -> DataFrame:
    """One row per item of a collection, with the ``keep`` columns.

    From a bare array column Catalyst derives a "not empty" filter and pushes it, with every expression the column is
    built from, to the bottom of the plan. A trivial expression around the column keeps it computed once.
    """
    col = F.col(arr) if isinstance(arr, str) else arr
    return df.select(*keep, F.inline(F.transform(col, lambda x: x)))


def sort(arr: Column, key: Callable[[Column], Column], desc: bool = False) -> Column:
    """Sort items by ``key``; equal keys keep the order of ``idx``."""
    ranked = F.transform(
        arr,
        lambda x: F.struct((-key(x) if desc else key(x)).alias("k"), x["idx"].alias("i"), x.alias("item")),
    )
    return F.sort_array(ranked)["item"]


def only_where(df: DataFrame, keep: Column, *names: str) -> DataFrame:
    """Collections that are NULL in the events for which ``keep`` does not hold: what is made of them costs nothing there."""
    return df.withColumns({c: F.when(keep, F.col(c)) for c in names})


def any_(arr: Column, pred: Predicate) -> Column:
    return F.exists(arr, lambda x: F.coalesce(pred(x), F.lit(False)))


def n(arr: Column) -> Column:
    return F.size(arr)


def at(arr: Column, i) -> Column:
    """Item ``i`` or NULL when the collection is shorter."""
    return F.get(arr, F.lit(i) if isinstance(i, int) else i)


def pairs(arr: Column, pred: PairPredicate) -> Column:
    """Unordered pairs (i < j) satisfying ``pred`` as ``struct<l1, l2>``, in lexicographic order."""
    return F.flatten(
        F.transform(
            arr,
            lambda x, i: F.transform(
                F.filter(F.slice(arr, i + 2, F.size(arr)), lambda y: F.coalesce(pred(x, y), F.lit(False))),
                lambda y: F.struct(x.alias("l1"), y.alias("l2")),
            ),
        )
    )


def cross(a: Column, b: Column, pred: PairPredicate) -> Column:
    """Pairs of one item of ``a`` and one of ``b`` satisfying ``pred``."""
    return F.flatten(
        F.transform(
            a,
            lambda x: F.transform(
                F.filter(b, lambda y: F.coalesce(pred(x, y), F.lit(False))),
                lambda y: F.struct(x.alias("l1"), y.alias("l2")),
            ),
        )
    )


def first_pair(arr: Column, pred: PairPredicate) -> Column:
    """First of :func:`pairs` or NULL, for a ``pred`` that holds between some items if the first differs from any."""
    head = at(arr, 0)
    other = at(select(arr, lambda y: pred(head, y)), 0)
    return F.when(other.isNotNull(), F.struct(head.alias("l1"), other.alias("l2")))


def first_cross(a: Column, b: Column, pred: PairPredicate) -> Column:
    """First of :func:`cross` or NULL."""
    own = at(select(a, lambda x: any_(b, lambda y: pred(x, y))), 0)
    other = at(select(b, lambda y: pred(own, y)), 0)
    return F.when(other.isNotNull(), F.struct(own.alias("l1"), other.alias("l2")))


def any_pair(arr: Column, pred: PairPredicate) -> Column:
    """Whether any two items satisfy the symmetric ``pred``; stops at the first, builds no pairs."""
    return any_(arr, lambda x: any_(arr, lambda y: (x["idx"] < y["idx"]) & pred(x, y)))


def any_cross(a: Column, b: Column, pred: PairPredicate) -> Column:
    return any_(a, lambda x: any_(b, lambda y: pred(x, y)))


def follow(target: Column, idx: Column) -> Column:
    """Item of ``target`` a cross-reference points to; NULL for a negative or out-of-range reference."""
    return F.when(idx >= 0, F.get(target, idx))


def clean(a: Column, b: Column, dr: float) -> Column:
    """Items of ``a`` with no item of ``b`` within ``dr`` (inclusive)."""
    return F.filter(a, lambda x: ~F.exists(b, lambda y: F.coalesce(kin.delta_r(x, y) <= dr, F.lit(False))))


def keep_apart(a: Column, b: Column, dr: float) -> Column:
    """Items of ``a`` at distance ``>= dr`` from every item of ``b``."""
    return F.filter(a, lambda x: F.forall(b, lambda y: F.coalesce(ops.at_least(kin.delta_r(x, y), dr), F.lit(False))))


def _axis(lep: Column) -> Column:
    return F.struct(*[lep[c].alias(c) for c in ("conept", "eta", "phi")])


def leading_one(electrons: Column, muons: Column) -> Column:
    """The lepton with the highest cone-pt as an array of 0 or 1 axes; the electron wins a tie."""
    e, m = at(electrons, 0), at(muons, 0)
    electron_leads = m.isNull() | (e["conept"] >= m["conept"])
    return F.filter(
        F.array(F.when(F.coalesce(electron_leads & e.isNotNull(), F.lit(False)), _axis(e)).when(m.isNotNull(), _axis(m))),
        lambda x: x.isNotNull(),
    )


def leading_two(electrons: Column, muons: Column) -> Column:
    """The two leading leptons as an array of 2 axes; empty when the event has fewer than two leptons.

    The muon takes the first place on a tie; for the second place a lepton of the leading flavour must be strictly
    harder than the best one of the other flavour.
    """
    e0, e1, m0, m1 = at(electrons, 0), at(electrons, 1), at(muons, 0), at(muons, 1)
    electron_first = F.array(_axis(e0), F.when(e1["conept"] > m0["conept"], _axis(e1)).otherwise(_axis(m0)))
    muon_first = F.array(_axis(m0), F.when(m1["conept"] > e0["conept"], _axis(m1)).otherwise(_axis(e0)))
    return (
        F.when(e0.isNotNull() & m0.isNotNull(), F.when(e0["conept"] > m0["conept"], electron_first).otherwise(muon_first))
        .when(e1.isNotNull(), F.array(_axis(e0), _axis(e1)))
        .when(m1.isNotNull(), F.array(_axis(m0), _axis(m1)))
        .otherwise(F.slice(F.array(_axis(e0)), 1, 0))
    )

