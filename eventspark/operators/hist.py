"""Weighted one-dimensional histograms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.functions import ops


@dataclass(frozen=True)
class Plot:
    """One histogram: a variable filled for the events of a selection flag, in ``n`` equal bins over [lo, hi)."""

    name: str
    flag: str
    var: Column
    n: int
    lo: float
    hi: float
    title: str = ""
    blinded: tuple[float, float] | None = None


def bin_index(var: Column, n: int | Column, lo: float | Column, hi: float | Column) -> Column:
    """Bin 1..n, 0 below ``lo``, n+1 from ``hi`` on and for NaN; NULL stays NULL (not filled)."""
    v = var.cast("double")
    n = n if isinstance(n, Column) else F.lit(n)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    inside = F.floor(n.cast("double") * (v - lo) / (hi - lo)).cast("int") + 1
    return (
        F.when(F.isnan(v) | (v >= hi), n + 1).when(v < lo, F.lit(0)).when(v.isNotNull(), F.least(inside, n))
    )


def _contents(weight: Column) -> list[Column]:
    return [
        F.sum(weight).alias("sumw"),
        F.sum(weight * weight).alias("sumw2"),
        F.count("*").alias("n"),
    ]


def fill(
    df: DataFrame, var: Column, n: int, lo: float, hi: float, weight: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Content, squared-weight sum and entries per bin (and per ``by`` columns).

    Rows without a value are dropped after the aggregation, by a count Catalyst cannot push down; a filter on the bin
    would be pushed below the projections and evaluate the variable again.
    """
    values = df.select(*by, var.cast("double").alias("_v"), weight.alias("_w"))
    binned = values.select(*by, "_w", bin_index(F.col("_v"), n, lo, hi).alias("bin"))
    contents = [*_contents(F.col("_w"))[:2], F.count("bin").alias("n")]
    return binned.groupBy(*by, "bin").agg(*contents).filter(F.col("n") > 0)


def fill_many(df: DataFrame, plots: Sequence[Plot], weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """All histograms in one pass over ``df``.

    An event turns into one (plot, value) row per histogram of the selections it passes, and emits nothing for the others.
    The rows are combined inside the partition before the only shuffle, whose size per task is histograms x bins x ``by``
    groups. The values are built inside the generator: from a named array column Catalyst would derive a "not empty" filter
    and push it, with every expression it depends on, below the object layer.
    """
    of_flag: dict[str, list[Column]] = {}
    for i, p in enumerate(plots):
        entry = F.struct(F.lit(i).alias("plot_id"), p.var.cast("double").alias("v"))
        of_flag.setdefault(p.flag, []).append(entry)
    none = F.array().cast("array<struct<plot_id:int,v:double>>")
    values = F.concat(*[F.when(F.col(f), F.array(*entries)).otherwise(none) for f, entries in of_flag.items()])
    flat = df.select(*by, weight.alias("_w"), F.inline(values))
    of_plot = lambda params: F.get(F.array(*[F.lit(x) for x in params]), F.col("plot_id"))
    lo, hi = of_plot([float(p.lo) for p in plots]), of_plot([float(p.hi) for p in plots])
    filled = flat.filter(F.col("v").isNotNull()).withColumn("bin", bin_index(F.col("v"), of_plot([p.n for p in plots]), lo, hi))
    summed = filled.groupBy(*by, "plot_id", "bin").agg(*_contents(F.col("_w")))
    return summed.select(of_plot([p.name for p in plots]).alias("plot"), *by, "bin", "sumw", "sumw2", "n")


def fold(hist: DataFrame, n: Column | int, by: Sequence[str]) -> DataFrame:
    """Show the overflow: add bin 0 to bin 1 and bin n+1 to bin n."""
    last = F.lit(n) if isinstance(n, int) else n
    folded = hist.withColumn("bin", F.least(F.greatest("bin", F.lit(1)), last))
    return folded.groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in ("sumw", "sumw2", "n")])


def adaptive(df: DataFrame, var: str, n: int, weight: Column, by: Sequence[str], closed: bool) -> DataFrame:
    """Histogram between the smallest and the largest value of ``var`` over the whole frame.

    With ``closed`` the last bin includes the maximum; without it a row at the maximum is left out (left-closed
    digitising). The range is a one-row scalar subquery, not a join. Rows with NULL or NaN are in no bin and do not move
    the range.
    """
    number = F.when(~F.isnan(var), F.col(var))
    edge = df.agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    lo, hi = edge.select("lo").scalar(), edge.select("hi").scalar()
    binned = df.select(*by, number.alias("_v"), weight.alias("_w"), lo.alias("_lo"), hi.alias("_hi"))
    binned = binned.filter(F.col("_v").isNotNull())
    width = F.col("_hi") - F.col("_lo")
    pos = F.floor(F.lit(float(n)) * F.try_divide(F.col("_v") - F.col("_lo"), width)).cast("int") + 1
    at_top = F.col("_v") >= F.col("_hi")
    index = F.when(at_top, n if closed else n + 1).otherwise(F.least(pos, F.lit(n)))
    out = binned.withColumn("bin", index).filter(F.col("bin").between(1, n))
    return out.groupBy(*by, "bin").agg(*_contents(F.col("_w")))


def every_bin(hist: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Add the empty bins 1..n of every ``by`` group."""
    grid = hist.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("bin"))
    full = grid.join(hist, [*by, "bin"], "left")
    return full.withColumns(
        {"sumw": F.coalesce("sumw", F.lit(0.0)), "sumw2": F.coalesce("sumw2", F.lit(0.0)), "n": F.coalesce("n", F.lit(0).cast("long"))}
    )


def cumulative(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left and right cumulative content of each group, divided by the group's total.

    The windows run over the bins of one histogram, never over events.
    """
    w = W.partitionBy(*by).orderBy("bin")
    left = F.sum("sumw").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    right = F.sum("sumw").over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("sumw").over(W.partitionBy(*by))
    return hist.withColumns({"cum_left": F.try_divide(left, total), "cum_right": F.try_divide(right, total)})
