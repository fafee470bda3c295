"""Joins that no key can make uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is joined by broadcast, as far as so many keys go; the keys beyond are shuffled.
HOT, BROADCAST, SALTS = 1000, 50_000, 1024


def join_unique(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left-joined with the columns of ``facts``, which has one row per ``key`` and, as ``count``, about how many
    ``rows`` have it.

    Facts of the most frequent keys are broadcast, at most ``BROADCAST`` of them; their rows, and rows with a null key, are
    dealt at random in the shuffle that joins all others. ``facts`` is read twice and should be stored. A null key meets
    nothing. ``rows`` must not have columns of the facts' names other than the key.
    """
    values = [c for c in facts.columns if c not in (key, count)]
    packed = facts.select(F.col(key).alias("_at"), count, F.struct(*values).alias("_facts"))
    hot = packed.filter(F.col(count) > HOT).orderBy(F.col(count).desc(), "_at").limit(BROADCAST)
    near = F.broadcast(hot.select(F.col("_at").alias("_near"), F.col("_facts").alias("_hot")))
    rows = rows.join(near, F.col(key) == F.col("_near"), "left")
    apart = F.col("_near").isNotNull() | F.col(key).isNull()
    salt = F.when(apart, 1 + F.floor(F.rand(7) * SALTS)).otherwise(0).cast("int")
    far = packed.select(F.col("_at").alias("_far"), F.col("_facts").alias("_cold"), F.lit(0).alias("_zero"))
    joined = rows.withColumn("_salt", salt).join(
        far, (F.col(key) == F.col("_far")) & (F.col("_salt") == F.col("_zero")), "left"
    )
    both = F.coalesce("_hot", "_cold")
    joined = joined.withColumns({v: both[v] for v in values})
    return joined.drop("_near", "_hot", "_salt", "_far", "_cold", "_zero")
