"""Systematic variations as rows or weight alternatives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions import coll
from eventspark.operators import weights

NOMINAL = "nominal"


def weight_variations(df: DataFrame, nominal: Column, alternatives: Mapping[str, Column]) -> DataFrame:
    """One row per variation with columns ``variation`` and ``weight``; every alternative replaces the weight."""
    options = {NOMINAL: nominal, **alternatives}
    rows = F.array(*[F.struct(F.lit(k).alias("variation"), w.cast("double").alias("weight")) for k, w in options.items()])
    keep = [c for c in df.columns if c not in ("variation", "weight")]
    return df.select(*keep, F.inline(rows))


def object_variations(
    df: DataFrame,
    factors: Mapping[str, float],
    collections: Sequence[str],
    varies: Column,
    met: tuple[str, str] | None = None,
    met_source: str | None = None,
    needed: Column | None = None,
) -> DataFrame:
    """Repeat events per named variation with the ``collections`` scaled, before objects that depend on them are defined.

    Rows for which ``varies`` is false (data) only get the nominal variation. The repetition happens inside each
    partition; nothing is shuffled. With ``met`` = (pt column, phi column), the missing momentum follows the scaling
    of ``met_source`` except for variations whose name starts with ``jer``; the sum of its momenta is made once per event.

    Events for which ``needed`` does not hold are repeated without the ``collections`` (NULL).
    """
    if met is not None and met_source is not None:
        if met_source not in collections:
            raise ValueError(f"the missing momentum follows {met_source}, which is not varied")
        df = df.withColumn("_sum", weights.vector_sum(F.col(met_source), "pt"))
    if needed is not None:
        df = coll.only_where(df, needed, *collections)
    named = [F.struct(F.lit(NOMINAL).alias("variation"), F.lit(1.0).alias("_factor"))]
    shifted = [F.struct(F.lit(k).alias("variation"), F.lit(f).alias("_factor")) for k, f in factors.items()]
    choices = F.when(varies, F.array(*named, *shifted)).otherwise(F.array(*named))
    out = df.select(*df.columns, F.inline(choices))
    scaled = {c: weights.scale_items(F.col(c), lambda _: F.col("_factor")) for c in collections}
    if met is not None and met_source is not None:
        pt, phi = weights.met_scaled(F.col(met[0]), F.col(met[1]), F.col("_sum"), F.col("_factor"))
        still = F.col("variation").startswith("jer") | (F.col("variation") == NOMINAL)
        scaled[met[0]] = F.when(still, F.col(met[0])).otherwise(pt)
        scaled[met[1]] = F.when(still, F.col(met[1])).otherwise(phi)
    return out.withColumns(scaled).drop("_factor", "_sum")
