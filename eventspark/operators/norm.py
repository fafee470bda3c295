"""Normalisation of samples to the recorded luminosity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.operators.literal import MAX_BROADCAST_ROWS


def weight_sums(events: DataFrame, weight: Column, sample: str = "sample") -> DataFrame:
    """Sum of generator weights per sample; run it before any cut."""
    return events.groupBy(sample).agg(F.sum(weight).alias("sumw"))


def scales(catalog: DataFrame, sums: DataFrame) -> DataFrame:
    """Per-sample yield scale: luminosity x cross-section x branching ratio / sum of weights, 1 for data.

    ``catalog`` has one row per sample (``sample, type, grp, luminosity, cross_section, branching_ratio``), which
    bounds the result whatever the event table holds.
    """
    expected = F.col("luminosity") * F.col("cross_section") * F.coalesce("branching_ratio", F.lit(1.0))
    scale = F.when(F.lower("type") == "data", 1.0).otherwise(F.try_divide(expected, F.col("sumw")))
    return catalog.join(sums, "sample", "left").withColumn("scale", scale)


def known_scale(sample: str = "sample", scale: str = "scale") -> Column:
    """The scale of a row's sample; a sample that is not listed, or lacks luminosity or cross-section, fails by name."""
    lost = F.concat(F.lit("no scale for sample "), F.coalesce(sample, F.lit("NULL")))
    return F.coalesce(F.col(scale), F.raise_error(lost).cast("double"))


def apply_scale(df: DataFrame, scale_table: DataFrame, n_samples: int, columns: tuple[str, ...] = ("weight",)) -> DataFrame:
    """Multiply ``columns`` by the scale of the row's sample (see :func:`known_scale`).

    ``n_samples`` is the known length of the catalogue; only a short one is broadcast.
    """
    s = scale_table.select("sample", "scale")
    joined = df.join(F.broadcast(s) if n_samples <= MAX_BROADCAST_ROWS else s, "sample", "left")
    return joined.withColumns({c: F.col(c) * known_scale() for c in columns}).drop("scale")
