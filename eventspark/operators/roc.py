"""ROC points, area, significance and working point of a weighted score.

Scores are first merged per distinct value, then cumulated with :mod:`eventspark.operators.prefix`, so no step sends
all rows to one task and the area needs no ordering at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.operators import prefix
from eventspark.operators.checkpoints import pinned

THRESHOLDS = 100


def score_groups(
    df: DataFrame,
    y: Column,
    score: Column,
    weight: Column,
    by: Sequence[str] = (),
    sig_weight: Column | None = None,
) -> DataFrame:
    """Weight of positives and negatives per distinct score; tied rows merge before the shuffle.

    ``s`` and ``b`` are the same sums with the weight used for the significance.
    """
    flat = df.select(
        *by,
        score.cast("double").alias("threshold"),
        (y == 1).alias("_y"),
        weight.cast("double").alias("_w"),
        (weight if sig_weight is None else sig_weight).cast("double").alias("_v"),
    )
    pick = lambda keep, w: F.sum(F.when(keep, F.col(w)).otherwise(0.0))
    return flat.groupBy(*by, "threshold").agg(
        pick(F.col("_y"), "_w").alias("pos"),
        pick(~F.col("_y"), "_w").alias("neg"),
        pick(F.col("_y"), "_v").alias("s"),
        pick(~F.col("_y"), "_v").alias("b"),
    )


def curve(
    df: DataFrame,
    y: Column,
    score: Column,
    weight: Column,
    by: Sequence[str] = (),
    sig_weight: Column | None = None,
    slices: int | None = None,
    drop_intermediate: bool = False,
) -> DataFrame:
    """ROC points, one per distinct score: ``tp``/``fp`` (weight at or above the threshold) and their rates.

    ``df`` is read once: the merged scores are stored, and slices and totals come from them.
    ``drop_intermediate`` leaves out points inside a straight line (equal steps before and after), keeping the ends.
    """
    groups = pinned(score_groups(df, y, score, weight, by, sig_weight))
    sliced = prefix.with_slice(groups, "threshold", prefix.slice_cuts(groups, "threshold", slices))
    sums = {"tp": F.col("pos"), "fp": F.col("neg"), "s_above": F.col("s"), "b_above": F.col("b"), "rank": F.lit(1)}
    points = prefix.running_totals(sliced, "threshold", sums, by, grand=("tp", "fp"))
    points = points.withColumns(
        {
            "tpr": F.try_divide("tp", "total_tp"),
            "fpr": F.try_divide("fp", "total_fp"),
            "s_above": F.col("s_above") - F.col("s"),
            "b_above": F.col("b_above") - F.col("b"),
        }
    ).drop("total_tp", "total_fp", "s", "b")
    return corners(points, by) if drop_intermediate else points


def corners(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Points where the curve changes direction, plus the first and the last one."""
    ahead = prefix.with_next(points, "threshold", ["pos", "neg"], by)
    straight = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
    keep = (F.col("rank") == 1) | ~F.coalesce(straight, F.lit(False))
    return ahead.filter(keep).drop("next_pos", "next_neg")


def thin(points: DataFrame, n: int = THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """Every ``len // n``-th point (at least every one) of each curve, counting its start as point 0."""
    kept = pinned(points.drop("rank"))
    numbered = prefix.running_totals(kept, "threshold", {"rank": F.lit(1)}, by, grand=("rank",))
    step = F.greatest(F.floor((F.col("total_rank") + 1) / n), F.lit(1))
    return numbered.filter(F.col("rank") % step == 0).drop("total_rank")


def significance_of(s: Column, b: Column) -> Column:
    """Counting significance of ``s`` over a known background ``b``; 0 where it is not defined."""
    log = F.log(1 + F.try_divide(s, b))
    radicand = (s + b) * log - s
    return F.when((b > 0) & (s > 0) & (radicand >= 0), F.sqrt(2 * radicand)).otherwise(0.0)


def significance(points: DataFrame, n: int = THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """Significance of the events strictly above each of about ``n`` thresholds of each curve."""
    return thin(points, n, by).select(
        *by, "threshold", "fpr", "s_above", "b_above", significance_of(F.col("s_above"), F.col("b_above")).alias("z")
    )


def best_working_point(sig: DataFrame) -> DataFrame:
    """Threshold with the largest significance, the highest one on a tie."""
    top = sig.agg(F.max(F.struct("z", "threshold")).alias("best"))
    return top.select(F.col("best.threshold").alias("threshold"), F.col("best.z").alias("z"))


def auc(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area from ROC points: each step's false-positive width times its mean height.

    Written with the step's own sizes the sum needs no neighbour and combines inside each partition.
    """
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return groups.groupBy(*by).agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def one_vs_rest(df: DataFrame, tag: Column, scores: dict[str, Column]) -> DataFrame:
    """Rows repeated per class with ``class``, ``y`` (1 for that class) and ``score`` (that class's score)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"), (tag == c).cast("int").alias("y"), s.cast("double").alias("score")
            )
            for c, s in scores.items()
        ]
    )
    return df.select("*", F.inline(rows))


def pairwise(df: DataFrame, tag: Column, classes: Sequence[str]) -> DataFrame:
    """Rows repeated per pair of classes (in list order) they belong to; ``y`` is 1 for the first of the pair."""
    pairs = [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]
    rows = F.array(
        *[
            F.when(
                tag.isin(a, b),
                F.struct(F.lit(a).alias("class_a"), F.lit(b).alias("class_b"), (tag == a).cast("int").alias("y")),
            )
            for a, b in pairs
        ]
    )
    return df.select("*", F.inline(F.array_compact(rows)))


# --- bounded curves for continuous scores -----------------------------------------------------------------------

#: Cells of a score grid.
CELLS = 4096


def grid(
    df: DataFrame, y: Column, score: Column, weight: Column, by: Sequence[str] = (), cells: int = CELLS, lo: float = 0.0, hi: float = 1.0
) -> DataFrame:
    """``(by, cell, pos, neg)``: weight of positives and negatives per cell of equal width over [lo, hi].

    Cells are the same for all data, so grids of parts add up (:func:`merged`), and at most ``cells`` rows a task are
    shuffled, however many distinct scores there are. A score beyond the ends counts in the last cell there; a null or NaN
    score counts nowhere.
    """
    value = score.cast("double")
    inside = F.floor((value - lo) / (hi - lo) * cells)
    cell = F.least(F.greatest(inside, F.lit(0)), F.lit(cells - 1)).cast("int")
    flat = df.select(*by, F.when(value.isNotNull() & ~F.isnan(value), cell).alias("cell"), (y == 1).alias("_y"), weight.cast("double").alias("_w"))
    pick = lambda keep: F.sum(F.when(keep, F.col("_w")).otherwise(0.0))
    counted = flat.groupBy(*by, "cell").agg(pick(F.col("_y")).alias("pos"), pick(~F.col("_y")).alias("neg"))
    return counted.filter(F.col("cell").isNotNull())


def merged(grids: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One grid from those of several parts of the data."""
    both = reduce(DataFrame.unionByName, grids)
    return both.groupBy(*by, "cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def grid_curve(cells_of: DataFrame, by: Sequence[str] = (), cells: int = CELLS, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """ROC points at the lower edges of the cells, where they are exact, with ``tpr_error`` and ``fpr_error``: how far the
    rates of a threshold inside a cell can be from those at its edge.

    The windows run over the cells of one grid, never over rows.
    """
    down = W.partitionBy(*by).orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*by)
    rate = lambda part, side: F.try_divide(part, F.sum(side).over(whole))
    totals = cells_of.select(
        "*",
        (F.col("cell") * ((hi - lo) / cells) + lo).alias("threshold"),
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(down).alias("fp"),
        rate(F.col("pos"), "pos").alias("tpr_error"),
        rate(F.col("neg"), "neg").alias("fpr_error"),
    )
    return totals.withColumns({"tpr": rate(F.col("tp"), "pos"), "fpr": rate(F.col("fp"), "neg")})


def grid_auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the points of :func:`grid_curve`, and ``error``: the area of the true curve, with all scores apart, differs
    by no more, as inside a cell positives and negatives may come in any order."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    unknown = F.sum(F.col("pos") * F.col("neg") / 2)
    both = F.sum("pos") * F.sum("neg")
    return points.groupBy(*by).agg(F.try_divide(area, both).alias("auc"), F.try_divide(unknown, both).alias("error"))
