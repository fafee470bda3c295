"""Bring item rows into one row per event.

An event is one key with all its items, whatever their number: counts, pairs, orders and cross references are those of the
whole event. The row of an event has to fit into memory, as it has for every reader of nested data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions import ops

#: Numbers per item and the least sum of each; a key is kept if one of the sums is reached.
Having = Sequence[tuple[Column, int]]


def nest_items(
    items: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], having: Having = ()
) -> DataFrame:
    """Items as one row per key, sorted by ``order``, then by whatever else they carry.

    The rows are shuffled as they are: collecting lists before the shuffle would not make them fewer. Their structs are made
    before it, in compiled code; an aggregate's input is interpreted.

    With ``having`` only the keys whose items reach one of its sums, with all their items.
    """
    fields = list(dict.fromkeys([*order, *fields]))
    counts = [n.alias(f"_n{i}") for i, (n, _) in enumerate(having)]
    grouped = items.select(key, F.struct(*fields).alias("_item"), *counts).repartition(key).groupBy(key)
    sums = [F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(having))]
    lists = grouped.agg(F.collect_list("_item").alias("items"), *sums)
    if having:
        lists = lists.filter(ops.any_of(*[F.col(f"_n{i}") >= least for i, (_, least) in enumerate(having)]))
    return lists.select(key, F.sort_array("items").alias("items"))


def nest(
    headers: DataFrame,
    header_key: str,
    items: DataFrame,
    item_key: str,
    order: Sequence[str],
    fields: Sequence[str],
    having: Having = (),
) -> DataFrame:
    """Headers with their ``items``; a header without items keeps an empty collection.

    With ``having`` only the headers whose items reach one of its sums.
    """
    nested = nest_items(items, item_key, order, fields, having)
    if having:
        return headers.join(nested.hint("merge"), F.col(header_key) == F.col(item_key)).drop(item_key)
    # both sides grow with the data: a sort-merge join on the key the items are already partitioned by
    joined = headers.join(nested.hint("merge"), F.col(header_key) == F.col(item_key), "left")
    empty = F.slice(F.array(F.lit(None).cast(nested.schema["items"].dataType.elementType)), 1, 0)
    return joined.drop(item_key).withColumn("items", F.coalesce("items", empty))
