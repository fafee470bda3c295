"""Preparation of a classifier's training table and evaluation of its scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.functions import ops
from eventspark.operators import hist, prefix, roc


def add_tag(df: DataFrame, process: str = "process", token: str = "HH", other: str = "background") -> DataFrame:
    """``tag`` = the token when the process name contains it."""
    return df.withColumn("tag", F.when(F.col(process).contains(token), token).otherwise(other))


def class_rows(df: DataFrame, classes: Sequence[str], tag: str = "tag") -> DataFrame:
    """``(tag, n)`` for every expected class, with 0 where it has no rows, from one aggregation."""
    counts = df.agg(*[F.count_if(F.col(tag) == c).alias(f"c{i}") for i, c in enumerate(classes)])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("tag"), F.col(f"c{i}").alias("n")) for i, c in enumerate(classes)]))
    )


def check_classes(df: DataFrame, classes: Sequence[str], tag: str = "tag") -> None:
    """Raise when an expected class has no rows."""
    missing = [r["tag"] for r in class_rows(df, classes, tag).collect() if not r["n"]]
    if missing:
        raise ValueError(f"classes without rows: {missing}")


def one_hot(df: DataFrame, classes: Sequence[str], tag: str = "tag") -> DataFrame:
    return df.withColumns({c: F.when(F.col(tag) == c, 1.0).otherwise(0.0) for c in classes})


def drop_nonpositive(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Keep rows with weight above zero (zero goes too)."""
    return df.filter(F.col(weight) > 0)


def count_nonpositive(df: DataFrame, weight: str = "weight") -> DataFrame:
    return df.agg(F.count("*").alias("n_total"), F.count_if(F.coalesce(F.col(weight) > 0, F.lit(False))).alias("n_kept"))


def _by_class(tag: str, values: Mapping[str, Column]) -> Column:
    """Value of the row's class."""
    out = F.lit(None)
    for c, v in values.items():
        out = F.when(F.col(tag) == c, v).otherwise(out)
    return out


def balance(df: DataFrame, classes: Sequence[str], tag: str = "tag", weight: str = "weight") -> DataFrame:
    """``event_weight`` and ``training_weight`` = weight x rows / weight sum of the row's class.

    The sums of the (listed) classes come from one map-side combined aggregation used as scalar values; rows are
    neither shuffled by class nor sent through a window.
    """
    sums = df.agg(
        F.count("*").alias("n"),
        *[F.sum(F.when(F.col(tag) == c, F.col(weight))).alias(f"w{i}") for i, c in enumerate(classes)],
    )
    n = sums.select("n").scalar().cast("double")
    factor = _by_class(tag, {c: F.try_divide(n, sums.select(f"w{i}").scalar()) for i, c in enumerate(classes)})
    return df.withColumn("event_weight", F.col(weight)).withColumn("training_weight", F.col(weight) * factor)


#: Row draws are whole numbers below this.
DRAWS = 2**52


def draw(key: Sequence[str], seed: int) -> Column:
    """A number below ``DRAWS`` per row: the first 13 hex digits of md5 of seed and key, joined by ``|``.

    The same for a key whatever the partitioning or the engine.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("long")


def batch_check(
    df: DataFrame, batch_size: int, key: Sequence[str], tag: str = "tag", weight: str = "weight", batches: int = 20, seed: int = 1
) -> DataFrame:
    """Mean weight sum and mean row count per class over random batches of ``batch_size`` rows.

    One scan: each batch starts at its own place on the circle of row draws and consists of the ``batch_size`` rows that
    follow. Only rows within about 3 x size / rows of a start are shuffled, keyed by batch; their number follows from
    ``batch_size``, not from the table. Batches of a large table share no row. ``key`` tells rows apart.
    """
    total = df.agg(F.count("*").alias("n")).scalar()
    reach = F.try_divide(F.lit(3.0 * batch_size * DRAWS), total)
    rows = df.select(F.col(tag).alias("tag"), F.col(weight).alias("_w"), draw(key, seed).alias("_u"), reach.alias("_reach"), *key)
    starts = F.array(*[F.struct(F.lit(i).alias("batch"), F.lit(i * (DRAWS // batches)).alias("at")) for i in range(batches)])
    placed = F.transform(starts, lambda s: F.struct(s["batch"].alias("batch"), F.pmod(F.col("_u") - s["at"], F.lit(DRAWS)).alias("_ahead")))
    near = rows.select("tag", "_w", *key, F.inline(F.filter(placed, lambda p: p["_ahead"] < F.col("_reach"))))
    ranked = near.withColumn("_r", F.row_number().over(W.partitionBy("batch").orderBy("_ahead", *key)))
    batch = ranked.filter(F.col("_r") <= batch_size)
    return batch.groupBy("tag").agg(
        (F.sum("_w") / batches).alias("mean_weight"), (F.count("*") / batches).alias("mean_rows")
    )


def weight_hist(
    df: DataFrame, classes: Sequence[str], bins: int = 100, tag: str = "tag", weight: str = "weight"
) -> DataFrame:
    """Weight distribution per class between the class's own smallest and largest weight, last bin closed.

    Rows with NULL or NaN are in no bin and do not move the range.
    """
    w = F.when(~F.isnan(weight), F.col(weight))
    edges = df.agg(
        *[f(F.when(F.col(tag) == c, w)).alias(f"{k}{i}") for i, c in enumerate(classes) for k, f in (("lo", F.min), ("hi", F.max))]
    )
    lo = _by_class(tag, {c: edges.select(f"lo{i}").scalar() for i, c in enumerate(classes)})
    hi = _by_class(tag, {c: edges.select(f"hi{i}").scalar() for i, c in enumerate(classes)})
    rows = df.filter(F.col(tag).isin(*classes) & w.isNotNull())
    rows = rows.select(tag, w.alias("_v"), lo.alias("_lo"), hi.alias("_hi"))
    pos = F.floor(F.lit(float(bins)) * F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    index = F.when(F.col("_v") >= F.col("_hi"), bins).otherwise(F.least(pos.cast("int") + 1, F.lit(bins)))
    return rows.groupBy(tag, index.alias("bin")).agg(F.count("*").alias("n"))


def is_even(phi: Column) -> Column:
    """Parity of the sixth decimal of ``|phi|``, computed in double precision."""
    scaled = F.abs(phi) * 1e5
    digit = ((scaled - F.floor(scaled)) * 10.0).cast("int")
    return digit % 2 == 0


def parity_split(df: DataFrame, phi: str = "leadingLepton_phi", split: str = "even") -> tuple[DataFrame, DataFrame]:
    """(train, test): an ``even`` model trains on odd rows and is tested on even ones, ``odd`` the other way."""
    if split not in ("even", "odd"):
        raise ValueError(f"split must be even or odd, not {split!r}")
    even = is_even(F.col(phi))
    first, second = df.filter(even), df.filter(~even)
    return (second, first) if split == "even" else (first, second)


def val_split(df: DataFrame, key: Sequence[str], percent: int = 30, seed: int = 0) -> DataFrame:
    """``is_val`` for about ``percent`` % of the rows, from a hash of ``key``: the same rows every time."""
    return df.withColumn("is_val", draw(key, seed) % 100 < percent)


def repeat_tail(df: DataFrame, q: float, weight: str = "training_weight") -> DataFrame:
    """Replace rows at or above the ``q`` quantile of the weight by ``int(w / quantile)`` copies of equal total weight."""
    limit = prefix.exact_quantile(df, weight, q).scalar()
    tagged = df.withColumn("_limit", limit)
    over = F.col(weight) >= F.col("_limit")
    copies = F.when(over, F.floor(F.try_divide(F.col(weight), F.col("_limit"))).cast("int")).otherwise(1)
    out = tagged.withColumn("n_copies", F.greatest(copies, F.lit(1))).withColumn(weight, F.col(weight) / F.col("n_copies"))
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy")).drop("_limit")


def summary(df: DataFrame, is_test: Column, is_val: Column) -> DataFrame:
    """Rows and percentage of the training, validation and test sets."""
    sets = F.when(is_test, "test").when(is_val, "validation").otherwise("training")
    total = df.agg(F.count("*").alias("n")).scalar()
    counts = df.groupBy(sets.alias("subset")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.try_divide(F.col("n") * 100.0, total))


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and sample variance per feature, one row per feature, from one aggregation."""
    aggs = [f(c).alias(f"{k}_{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("v", F.var_samp))]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"m_{i}").alias("mean"), F.col(f"v_{i}").alias("variance"))
            for i, c in enumerate(features)
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


def normalise(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features of ``df`` shifted and scaled by the mean and sample variance of ``train``."""
    stats = train.agg(*[f(c).alias(f"{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    stat = lambda name: stats.select(name).scalar()
    return df.withColumns({c: F.try_divide(F.col(c) - stat(f"m_{c}"), stat(f"s_{c}")) for c in features})


def discriminant(signal: Sequence[Column], other: Sequence[Column]) -> Column:
    """ln(sum of signal probabilities / sum of the others); NULL when the denominator or the ratio is 0."""
    total = lambda cols: sum(cols[1:], cols[0])
    ratio = F.try_divide(total(list(signal)), total(list(other)))
    return F.log(F.when(ratio > 0, ratio))


def categorise(score: Column, edges: Sequence[tuple[float, float]]) -> Column:
    """Number (1..n) of the open interval that contains the score; NULL on a boundary or outside."""
    return ops.multi_switch(*[(inside, F.lit(i)) for i, inside in category_cuts(score, edges).items()], default=F.lit(None))


def category_cuts(score: Column, edges: Sequence[tuple[float, float]]) -> dict[int, Column]:
    """Number (from 1) and condition of each open interval."""
    return {i: ops.in_range(lo, score, hi) for i, (lo, hi) in enumerate(edges, 1)}


# Score intervals of the four event categories.
SCORE_EDGES = ((0.1, 0.6), (0.6, 0.8), (0.8, 0.92), (0.92, 1.0))


def evaluate(df: DataFrame, y: Column, p: Column, weight: Column, threshold: float = 0.5) -> DataFrame:
    """Weighted cross-entropy, and unweighted accuracy, precision, recall and ROC area.

    The area comes from merged scores, everything else from one aggregation. ``p`` is the probability of class 1, kept inside [1e-7, 1 - 1e-7] for the logarithm.
    """
    eps = 1e-7
    kept = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    loss = -F.when(y == 1, F.log(kept)).otherwise(F.log(1 - kept))
    called = p > threshold
    yes, no = y == 1, y != 1
    return df.agg(
        F.try_divide(F.sum(weight * loss), F.count("*")).alias("loss"),
        F.avg(F.when(called == yes, 1.0).otherwise(0.0)).alias("accuracy"),
        F.try_divide(F.count_if(called & yes).cast("double"), F.count_if(called)).alias("precision"),
        F.try_divide(F.count_if(called & yes).cast("double"), F.count_if(yes)).alias("recall"),
        F.count_if(called & no).alias("false_positives"),
        F.count("*").alias("n"),
    ).withColumn("auc", roc.auc(roc.curve(df, y, p, F.lit(1.0))).scalar())
