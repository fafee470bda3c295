"""Connected components by repeated contraction; no component is ever held by one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every end of ``edges (a, b)``; ``root`` is some node of the component, the same for all of it.

    Each round maps a node to the neighbour of least hash, and that one's again, and keeps the edges between different
    images: the image of a connected graph is connected. Hash order makes long chains of descending nodes improbable,
    so the number of rounds grows with the logarithm of the size. Loops, repeated edges and nulls are ignored; no edges
    give no rows.
    """
    spread = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    edges = stored(edges.distinct())
    labels = None
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        best = F.least(F.min(spread("b")), F.min(spread("a")))["x"]
        hooks = ends.groupBy("a").agg(best.alias("up")).select(F.col("a").alias("node"), "up")
        top = hooks.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step = stored(hooks.join(top, "up").select("node", "root"))
        at = lambda end: step.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        image = edges.join(at("a"), "a").join(at("b"), "b")
        edges = stored(
            image.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
            .filter("a < b")
            .distinct()
        )
        if labels is None:
            labels = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
            labels = labels.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stored(labels)
