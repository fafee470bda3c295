"""Predicates and switches over columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def passed(cut: Column) -> Column:
    """A cut that cannot be evaluated (absent item) is a failed cut."""
    return F.coalesce(cut, F.lit(False))


def all_of(*cuts: Column) -> Column:
    return reduce(and_, cuts) if cuts else F.lit(True)


def any_of(*cuts: Column) -> Column:
    return reduce(or_, cuts) if cuts else F.lit(False)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def at_least(x: Column, low) -> Column:
    """``x >= low`` that is false for NaN (Spark orders NaN above every number, and its negative is NaN too)."""
    return -x <= -low


def above(x: Column, low) -> Column:
    """``x > low`` that is false for NaN."""
    return -x < -low


def in_range(low, x: Column, high) -> Column:
    """Open interval: both ends are excluded."""
    return (x > low) & (x < high)


def bit(flags: Column, n: int) -> Column:
    """True when bit ``n`` of an integer column is set."""
    return F.shiftright(flags, n).bitwiseAND(F.lit(1)) == 1


def multi_switch(*cases: tuple[Column, Column], default) -> Column:
    """First matching case wins; ``default`` when none matches."""
    (cond, value), *rest = cases
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out.otherwise(default)


def lead_sub(a: Column, b: Column) -> tuple[Column, Column]:
    """(leading, sub-leading) of two items by ``pt``; ``a`` leads on a tie.

    Both items must have the same struct type; use :func:`four_vector` on items of different kinds.
    """
    first = a["pt"] >= b["pt"]
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)

