"""Cut-flows, stacks, data/simulation comparison and yield tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.operators.norm import known_scale
from eventspark.operators.selection import Selection, expanded


def cutflow(df: DataFrame, selections: Sequence[Selection], weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """Raw and weighted yield of every selection and all its ancestors from a single aggregation.

    ``df`` carries the flag columns; each selection counts with the weight of its own lineage on top of ``weight``.
    """
    nodes = expanded(selections)
    aggs = []
    for i, node in enumerate(nodes):
        w = weight * node.total_weight()
        flag = F.col(node.flag)
        aggs += [
            F.count_if(flag).alias(f"n_{i}"),
            F.coalesce(F.sum(F.when(flag, w)), F.lit(0.0)).alias(f"w_{i}"),
            F.coalesce(F.sum(F.when(flag, w * w)), F.lit(0.0)).alias(f"v_{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(node.name).alias("selection"),
                F.lit(len(node.lineage()) - 1).alias("depth"),
                F.col(f"n_{i}").alias("n"),
                F.col(f"w_{i}").alias("sumw"),
                F.col(f"v_{i}").alias("sumw2"),
            )
            for i, node in enumerate(nodes)
        ]
    )
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))


def by_group(hist: DataFrame, catalog: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge the histograms of the samples of one process group, scaled to the expected yield.

    ``hist`` is already aggregated (samples x bins), so this join never sees events. A sample without a group keeps
    its own name; group names are compared without case.
    """
    info = catalog.select("sample", F.lower(F.coalesce("grp", "sample")).alias("grp"), F.lower("type").alias("type"), "scale")
    joined = hist.join(info, "sample", "left")
    scale = known_scale()
    return joined.groupBy(*by, "grp", "type", "bin").agg(
        F.sum(F.col("sumw") * scale).alias("sumw"),
        F.sum(F.col("sumw2") * scale * scale).alias("sumw2"),
        F.sum("n").alias("n"),
    )


def stack(grouped: DataFrame, by: Sequence[str]) -> DataFrame:
    """Order simulated groups by yield and add the running total per bin (smallest yield at the bottom).

    All windows run over groups of one histogram.
    """
    mc = grouped.filter(F.col("type") != "data")
    totals = mc.groupBy(*by, "grp").agg(F.sum("sumw").alias("yield"))
    order = W.partitionBy(*by).orderBy("yield", "grp")
    ranked = totals.withColumn("rank", F.row_number().over(order))
    pile = W.partitionBy(*by, "bin").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return mc.join(ranked, [*by, "grp"]).withColumn("stacked", F.sum("sumw").over(pile))


def ratio(grouped: DataFrame, by: Sequence[str]) -> DataFrame:
    """Data over simulation per bin, with the statistical error of the data and the relative one of the simulation."""
    is_data = F.col("type") == "data"
    pick = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0.0))
    sums = grouped.groupBy(*by, "bin").agg(
        pick("sumw", is_data).alias("data"),
        pick("sumw", ~is_data).alias("mc"),
        pick("sumw2", is_data).alias("data_w2"),
        pick("sumw2", ~is_data).alias("mc_w2"),
    )
    return sums.select(
        *by,
        "bin",
        "data",
        "mc",
        F.try_divide("data", "mc").alias("ratio"),
        F.try_divide(F.sqrt("data_w2"), F.col("mc")).alias("ratio_err"),
        F.try_divide(F.sqrt("mc_w2"), F.abs("mc")).alias("mc_rel_err"),
    )


def blind(hist: DataFrame, n: int, lo: float, hi: float, blinded: tuple[float, float], columns: Sequence[str] = ("sumw", "sumw2", "n")) -> DataFrame:
    """Hide data in every bin that overlaps the blinded range."""
    width = (hi - lo) / n
    left = F.lit(float(lo)) + (F.col("bin") - 1) * F.lit(width)
    hidden = (F.lower("type") == "data") & (left < blinded[1]) & (left + F.lit(width) > blinded[0])
    return hist.withColumns({c: F.when(~hidden, F.col(c)) for c in columns})


def yields(flow: DataFrame, catalog: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Selection x process-group table of scaled yields from a per-sample cut-flow."""
    info = catalog.select("sample", F.lower(F.coalesce("grp", "sample")).alias("grp"), "scale")
    total = F.sum(F.col("sumw") * known_scale())
    return (
        flow.join(info, "sample", "left")
        .groupBy("selection")
        .pivot("grp", [g.lower() for g in groups])
        .agg(total)
        .na.fill(0.0)
    )


def combine_eras(hist: DataFrame, by: Sequence[str], eras: Sequence[str] | None = None) -> DataFrame:
    """Drop the era from the keys, keeping only ``eras`` when given."""
    kept = hist if eras is None else hist.filter(F.col("era").isin(*eras))
    return kept.groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in ("sumw", "sumw2", "n")])
