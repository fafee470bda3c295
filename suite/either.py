"""One query over both plans for collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventspark.operators.crowded_objects import Crowd
from eventspark.plans import fixture as fx

_CROWDS = {fx.items: fx.crowd_of_items, fx.item_lists: fx.crowd_of_lists, fx.collisions: fx.crowd_of_collisions}


def either(
    spark: SparkSession,
    sf_dir: str,
    frame: Callable[..., DataFrame],
    nested: Callable[[DataFrame], DataFrame],
    crowd: Callable[[Crowd], DataFrame],
    *names: tuple[str, ...],
) -> DataFrame:
    """``nested`` over the events of ``frame``, and ``crowd`` over those too large to be nested, if there are any."""
    keys = fx.crowded_orders(spark, sf_dir)
    out = nested(frame(spark, sf_dir, *names, without=keys))
    if keys is None:
        return out
    return out.unionByName(crowd(_CROWDS[frame](spark, sf_dir, keys, *names)).select(out.columns))
