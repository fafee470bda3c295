"""Exact running totals over a global order without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.operators.checkpoints import pinned

MIN_SLICES, MAX_SLICES = 16, 1024


def slice_count(df: DataFrame) -> int:
    """As many slices as shuffle tasks, within limits that keep the cut array small."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(tasks, MIN_SLICES), MAX_SLICES)


def slice_cuts(df: DataFrame, order: str, slices: int | None = None) -> Column:
    """Approximate quantiles of ``order``, highest first, as a one-row scalar subquery (a bounded array).

    They only decide how rows are spread over tasks; results do not depend on them, so a sketch that errs by a quarter
    of a slice will do, and what the merging task receives stays small.
    """
    slices = slices or slice_count(df)
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = F.array_distinct(F.percentile_approx(order, shares, 4 * slices))
    return df.agg(F.sort_array(cuts, asc=False).alias("cuts")).scalar()


def with_slice(df: DataFrame, order: str, cuts: Column) -> DataFrame:
    """``slice`` numbers consecutive value ranges from the highest (0) down: the number of cuts above the value.

    Found by bisection, halving the step from ``MAX_SLICES``.
    """
    steps = F.array(*[F.lit(2**i) for i in reversed(range(MAX_SLICES.bit_length()))])
    climb = lambda at, step: F.when(F.get("_cuts", at + step - 1) > F.col(order), at + step).otherwise(at)
    tagged = df.withColumn("_cuts", cuts)
    return tagged.withColumn("slice", F.aggregate(steps, F.lit(0), climb)).drop("_cuts")


def running_totals(
    sliced: DataFrame, order: str, sums: Mapping[str, Column], by: Sequence[str] = (), grand: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running ``sums`` from the highest ``order`` value down, per ``by`` group.

    ``grand`` names sums whose total over the group is added as ``total_<name>``. Rows must be unique per (by, order).
    Each slice is summed on its own; what lies above it comes from a table with one row per (by, slice), joined on the
    columns the window is already partitioned by.
    """
    rows = W.unboundedPreceding
    inside = W.partitionBy(*by, "slice").orderBy(F.col(order).desc()).rowsBetween(rows, W.currentRow)
    above = W.partitionBy(*by).orderBy("slice").rowsBetween(rows, -1)
    whole = W.partitionBy(*by)
    per_slice = sliced.groupBy(*by, "slice").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    offsets = per_slice.select(
        *by,
        "slice",
        *[F.coalesce(F.sum(f"_{k}").over(above), F.lit(0)).alias(f"_{k}") for k in sums],
        *[F.sum(f"_{k}").over(whole).alias(f"total_{k}") for k in grand],
    )
    local = sliced.select("*", *[F.sum(c).over(inside).alias(f"_in_{k}") for k, c in sums.items()])
    joined = local.join(offsets, [*by, "slice"])
    return joined.withColumns({k: F.col(f"_in_{k}") + F.col(f"_{k}") for k in sums}).drop(
        *[f"_in_{k}" for k in sums], *[f"_{k}" for k in sums]
    )


def with_next(sliced: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``next_<column>`` of the row that follows in descending ``order`` (NULL after the last one).

    The last row of a slice looks at the first row of the next slice that has rows.
    """
    inside = W.partitionBy(*by, "slice").orderBy(F.col(order).desc())
    across = W.partitionBy(*by).orderBy("slice")
    head = F.max_by(F.struct(*columns), order)
    heads = sliced.groupBy(*by, "slice").agg(head.alias("_head"))
    following = heads.select(*by, "slice", F.lead("_head").over(across).alias("_head"))
    local = sliced.withColumn("_next", F.lead(F.struct(*columns)).over(inside))
    joined = local.join(following, [*by, "slice"])
    return joined.withColumns(
        {f"next_{c}": F.coalesce(F.col("_next"), F.col("_head"))[c] for c in columns}
    ).drop("_next", "_head")


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Interpolated ``q`` quantile as one row (``value``), without holding the values in one task.

    Values are counted, ranked with :func:`running_totals`, and only the two at the wanted positions are kept.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    counted = pinned(counted)
    sliced = with_slice(counted, "v", slice_cuts(counted, "v"))
    ranked = running_totals(sliced, "v", {"from_top": F.col("n")}, grand=("from_top",))
    first = F.col("total_from_top") - F.col("from_top")
    want = F.lit(float(q)) * (F.col("total_from_top") - 1)
    covers = lambda pos: (pos >= first) & (pos < first + F.col("n"))
    low, high = F.floor(want), F.ceil(want)
    ends = ranked.filter(covers(low) | covers(high)).agg(
        F.max(F.when(covers(low), F.col("v"))).alias("lo"),
        F.max(F.when(covers(high), F.col("v"))).alias("hi"),
        F.max(want - low).alias("part"),
    )
    return ends.select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))
