"""Bounded ROC curves: what they state holds for the exact curve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventspark.operators import roc


def scored(spark, n=3000, seed=1):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(r.normal(size=n) + 1.2 * y)))
    w = r.uniform(0.1, 3, n)
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(y, p, w, strict=True)]
    return spark.createDataFrame(rows, "y int, p double, w double"), y, p, w


@pytest.mark.parametrize("cells", [4, 64, 4096])
def test_errors_hold_for_the_exact_curve(spark, cells):
    df, y, p, w = scored(spark)
    points = roc.grid_curve(roc.grid(df, F.col("y"), F.col("p"), F.col("w"), cells=cells), cells=cells)
    order = np.argsort(-p)
    tp, fp = np.cumsum((w * y)[order]) / (w * y).sum(), np.cumsum((w * (1 - y))[order]) / (w * (1 - y)).sum()
    area = float((np.diff(np.r_[0, fp]) * (tp + np.r_[0, tp[:-1]]) / 2).sum())
    auc, error = roc.grid_auc(points).first()
    assert abs(auc - area) <= error + 1e-12 and (cells < 64 or error < 0.02)
    for r in points.collect():
        above = p >= r.threshold
        assert r.tpr == pytest.approx((w * y)[above].sum() / (w * y).sum()) and r.fpr == pytest.approx((w * (1 - y))[above].sum() / (w * (1 - y)).sum())
        inside = above & (p < r.threshold + 1 / cells)
        for t in p[inside][:5]:
            rate = (w * y)[p >= t].sum() / (w * y).sum()
            assert r.tpr - r.tpr_error - 1e-12 <= rate <= r.tpr + 1e-12


def test_grids_of_parts_add_up_and_odd_scores_have_a_place(spark):
    df, *_ = scored(spark, 500)
    odd = spark.createDataFrame([(1, -3.0, 1.0), (0, 9.0, 1.0), (1, 1.0, 1.0), (1, float("nan"), 5.0), (1, None, 5.0)], df.schema)
    df = df.unionByName(odd)
    make = lambda d: roc.grid(d, F.col("y"), F.col("p"), F.col("w"), cells=16)
    whole = {r.cell: (r.pos, r.neg) for r in make(df).collect()}
    parts = {r.cell: (r.pos, r.neg) for r in roc.merged([make(df.filter("w < 1")), make(df.filter("w >= 1"))]).collect()}
    assert set(whole) == set(parts) <= set(range(16))
    assert all(whole[c] == pytest.approx(parts[c]) for c in whole)
    assert make(odd).agg(F.sum("pos"), F.sum("neg")).first()[:] == (2.0, 1.0)
    assert roc.grid_auc(roc.grid_curve(make(df.limit(0)), cells=16)).first()[:] == (None, None)


def test_scores_are_not_shuffled(spark, capsys):
    df, *_ = scored(spark, 100)
    roc.grid_curve(roc.grid(df, F.col("y"), F.col("p"), F.col("w"))).explain()
    plan = capsys.readouterr().out
    moved = [x for x in plan.splitlines() if "Exchange" in x]
    assert moved and all("p#" not in x for x in moved) and "partial_sum" in plan
